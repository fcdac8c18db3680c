"""What a Python task holds while it settles a bucket."""

import weakref

import numpy as np
import pyarrow as pa

from chronopanel.llm import superwindows
from chronopanel.llm.superwindows import dealer, settler, word_symbols


def test_pieces_read_from_a_bucket_replace_its_text(monkeypatch):
    texts = [" ".join(f"w{i}" for i in range(40)), " ".join(f"w{i}" for i in range(5, 45)), " ".join(f"x{i}" for i in range(60))]
    batch = lambda i: pa.RecordBatch.from_arrays([pa.array([i]), pa.array([7 + i]), pa.array([texts[i]])], names=["doc_id", "text_hash", "text"])
    deal = dealer(word_symbols, 35, 4, 1, np.array([16384], np.int64), False)
    table = pa.Table.from_batches([b for i in range(3) for b in deal([batch(i)])])
    real, raw = superwindows.unpacked, []

    def unpacked(*a):
        out = real(*a)
        raw.append([weakref.ref(x) for x in out])
        return out

    seen = {}

    def settle(pieces):
        seen["alive"] = sum(r() is not None for refs in raw for r in refs)
        seen["docs"] = sorted(set(pieces.doc_id.tolist()))
        return [np.zeros(0, np.int64)] * 4

    monkeypatch.setattr(superwindows, "unpacked", unpacked)
    settler(settle, 1)(table)
    assert seen == {"alive": 0, "docs": [0, 1]} and len(raw) == table.num_rows
