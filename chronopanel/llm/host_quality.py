"""Quality rules on two levels: rules on a document, and verdicts on its host.

The document's numbers come from one Arrow pass. Each rule's failures are summed per host (partial sums
first, so a hot host is a few rows per task), the failure rates are shrunk by a beta prior fitted to all
hosts by moments, and a host whose shrunk rate exceeds a limit rejects all its documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..shared import BROADCAST_ROWS, stage
from .common import fields, names

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SYMBOLS = "#*$%&|<>"
_BLANK = " \t\n\x0b\x0c\r"
#: rule -> (SQL condition of failing, largest share of failing documents a host may have)
RULES = {
    "short": ("{m}n_words < 50", 0.6),
    "repetitive": ("100 * {m}n_repeat_words > 50 * {m}n_words", 0.5),
    "symbols": ("10 * {m}n_symbols > {m}n_words", 0.5),
    "repeated_lines": ("20 * {m}n_dup_lines > {m}n_words", 0.5),
    "word_length": ("{m}word_chars < 2 * {m}n_words OR {m}word_chars > 15 * {m}n_words", 0.5),
}
BASE = ("short", "repetitive")


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found at least twice in the list."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    pair = code[:-2] * len(ids) + code[1:-1]
    if len(ids) > 2_000_000:  # three codes no longer fit 63 bits: number the pairs first
        pair = np.unique(pair, return_inverse=True)[1]
    _, at, count = np.unique(pair * len(ids) + code[2:], return_inverse=True, return_counts=True)
    twice = count[at] > 1
    hit = np.zeros(n, bool)
    for i in range(3):
        hit[i:n - 2 + i] |= twice
    return int(hit.sum())


def measure_text(text: str) -> tuple[int, int, int, int, int]:
    words = text.encode("utf-8", "surrogatepass").split()
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if line.strip(_BLANK):
            repeated += line in seen
            seen.add(line)
    chars = len(text) - sum(map(text.count, _BLANK))
    return len(words), chars, sum(map(text.count, SYMBOLS)), repeated, repeated_words(words)


@F.pandas_udf(fields(MEASURES))
def _measures(text: pd.Series) -> pd.DataFrame:
    rows = [measure_text(t) for t in text]
    return pd.DataFrame(np.array(rows, np.int64).reshape(-1, 5), columns=[c.split()[0] for c in MEASURES.split(", ")])


def measures(text: Column) -> Column:
    """The document's numbers as a struct; a null text has no words."""
    return _measures(F.coalesce(text.cast("string"), F.lit("")))


def host_rates(measured: DataFrame, host: str) -> DataFrame:
    """Per host: documents, and for each rule the shrunk failure rate; ``host_failed`` where one exceeds
    its limit. ``measured`` has the host column and the columns of ``MEASURES``.

    Prior of a rule: with hosts i, n_i documents, rates p_i and m = all failures / all documents, the
    variance between hosts is v = sum n_i (p_i - m)^2 / sum n_i - m (1 - m) H / sum n_i; the prior weighs
    s = m (1 - m) / v - 1 documents, held between 1 and 10000."""
    fails = [F.sum(F.expr(f"CASE WHEN {cond.format(m='')} THEN 1 ELSE 0 END")).alias(f"k_{r}") for r, (cond, _) in RULES.items()]
    hosts = stage(measured.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n"), *fails), "hosts")
    sums = hosts.agg(F.count(F.lit(1)).alias("h"), F.sum("n").alias("n"), *[F.sum(f"k_{r}").alias(f"k_{r}") for r in RULES],
                     *[F.sum(F.expr(f"cast(k_{r} as double) * k_{r} / n")).alias(f"q_{r}") for r in RULES]).first()
    failed = F.lit(False)
    for r, (_, most) in RULES.items():
        n = sums["n"] or 1
        m = (sums[f"k_{r}"] or 0) / n
        v = (sums[f"q_{r}"] or 0.0) / n - m * m - m * (1 - m) * sums["h"] / n
        s = min(max(m * (1 - m) / v - 1, 1.0), 10_000.0) if v > 0 else 10_000.0
        rate = (F.col(f"k_{r}") + F.lit(m * s)) / (F.col("n") + F.lit(s))
        hosts = hosts.withColumn(f"rate_{r}", rate)
        failed = failed | (rate > most)
    return hosts.select("host", F.col("n").alias("host_docs"), *[f"rate_{r}" for r in RULES], failed.alias("host_failed"))


def judge_documents(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """All columns of ``docs`` and, under ``quality``, a struct of the measures, base_failed, host_failed
    and kept (neither failed).

    A null text has no words and fails; a null host is no host and never rejects its documents; repeated
    rows count as often as they occur; an empty table stays empty. Reads ``docs`` twice (once for the hosts). The
    hosts are broadcast if they are counted to be few; otherwise the documents are joined with them by host."""
    docs = docs.drop("quality")
    m = docs.select(F.col(host).alias("host"), measures(F.col(text)).alias("m")).select("host", "m.*")
    hosts = host_rates(m, "host").select(F.col("host").alias("__host"), F.col("host_failed").alias("__host_failed"))
    if hosts.count() <= BROADCAST_ROWS:
        hosts = F.broadcast(hosts)
    base = " OR ".join(f"({RULES[r][0].format(m='__m.')})" for r in BASE)
    out = docs.withColumn("__m", measures(F.col(text))).join(hosts, F.col(host) == F.col("__host"), "left")
    out = out.withColumn("__base", F.expr(base)).withColumn("__bad", F.coalesce("__host_failed", F.lit(False)))
    numbers = [F.col(f"__m.{c.split()[0]}").alias(c.split()[0]) for c in MEASURES.split(", ")]
    quality = F.struct(*numbers, F.col("__base").alias("base_failed"), F.col("__bad").alias("host_failed"), (~F.col("__base") & ~F.col("__bad")).alias("kept"))
    return out.select(*names(docs), quality.alias("quality"))
