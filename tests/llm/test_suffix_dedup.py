import hashlib
import random

import numpy as np
import pytest

from riskloom.llm import suffix_dedup


def _plain(rows):
    seen, out = set(), {}
    for i, text in sorted(rows.items()):
        b = (text or "").encode()
        covered = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k:k + 100] in seen:
                covered[k:k + 100] = b"\1" * 100
            seen.add(b[k:k + 100])
        kept = bytes(x for x, c in zip(b, covered) if not c)
        runs = sum(c and not (j and covered[j - 1]) for j, c in enumerate(covered))
        out[i] = (len(b), sum(covered), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("shard", [3 << 20, 5000])
def test_equals_plain_removal(texts, monkeypatch, shard):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    r = random.Random(shard)
    base = "".join(r.choice("abcdé ") for _ in range(900))
    rows = {0: None, 1: "", 2: "ab" * 200, 3: "x" + "ab" * 180, 4: "q" * 100, 5: "q" * 101, 6: "abc" * 40 + "z" * 99}
    for k in range(25):
        t = list(base)
        for _ in range(r.randrange(8)):
            t[r.randrange(len(t))] = r.choice("XYZ")
        rows[10 + k] = "".join(t[r.randrange(50):])
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"])
           for x in suffix_dedup.deduplicate(texts(rows).repartition(4)).collect()}
    assert got == _plain(rows)


def test_ranks_order_suffixes():
    data = np.frombuffer(b"banana" * 5 + b"bandana\x00" + b"banana", np.uint8)
    raw, rank = data.tobytes(), suffix_dedup.suffix_ranks(data, 20)
    cut = [raw[i:i + 20] for i in range(len(raw))]
    assert [sum(o < c for o in cut) for c in cut] == rank.tolist()


def test_odd_rows(odd, none):
    rows = suffix_dedup.deduplicate(odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[6]["n_removed"] == 0 and by[7]["n_removed"] == by[7]["n_bytes"]
    assert all(r["n_removed"] == 0 for r in rows if r["doc_id"] == 8) and None in by
    assert suffix_dedup.deduplicate(none).collect() == []
