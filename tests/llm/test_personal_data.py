import hashlib
import random
import re
from collections import Counter

import pytest

from riskloom.llm import personal_data as pii
from riskloom.llm.common import read

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in twice) % 10 == 0


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in match.split(".")),
            "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]


def base(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items()
                    for m in re.finditer(p, text or "") if passes(k, m[0]))


def check(rows, texts):
    for r in rows:
        want = base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), (texts[r["doc_id"]], want, r)
        assert [r[f"n_{k}"] for k in PATTERNS] == [want.count(f"{k}:") for k in PATTERNS]
        assert not want or r["spans"] == want or r["spans"].startswith(want + ",")


def test_base_spans_of_hard_texts(texts):
    values = {
        1: None, 2: "", 3: "a@b.c_d@e.f.g-h@i@j.k", 4: "é😀 x.y+z%w@mail-1.example.com, Ö@b.de a@b a@.b", 5: "a@b.c" * 50,
        6: "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 0000000000000001.1.1.1 1.2.3.4x 9.9.9", 7: "1.1.1.1" * 40,
        8: "4111 1111 1111 1111 4111-1111-1111-1111-1 4111111111111111 4111  1111 1111 1111 378282246310005",
        9: "+1 (801) 555-1234 +49.30.123456 ++1 22 33 44 55 66 77 88 99 00 11 +1 +12345678) +1((((((((22222222",
        10: "9" * 5000, 11: "1 " * 6000, 12: "a." * 5000 + "@", 13: "+1" + "(" * 5000, 14: "12345678901234567890 6011000990139424",
        15: "é@b.cé 4000 0000 0000 0002,5105105105105100\n+44 20 7946 0958\n10.0.0.255", 16: "a@b.c-d.e--.f @@a@b.c",
    }
    check(pii.digest(texts(values)).collect(), values)


def test_base_spans_of_random_texts(texts):
    r = random.Random(8)
    parts = ["a", "b.c", "@", "x@y.z", ".", "1", "12", "255", "300", "1.2.3.4", "-", " ", "+", "+1", "(", ")", "555-0199",
             "4111111111111111", "4111 1111 1111 1111", "é", "😀", "_", "0"]
    values = {i: "".join(r.choices(parts, k=r.randrange(1, 40))) for i in range(1500)}
    check(pii.digest(texts(values)).collect(), values)


def test_whole_table_against_brute_force(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    values = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    rows = pii.digest(docs).collect()
    assert len(rows) == len(values)
    check(rows, values)


def labelled(seed, n):
    """Documents with one span of another kind each, private or not."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("123456789") for _ in range(k))
    out = []
    for i in range(n):
        kind, private = r.choice(["ssn", "local", "name", "written"]), r.random() < 0.5
        value = {
            "ssn": f"{r.randrange(100, 600)}-{r.randrange(10, 99)}-{r.randrange(1000, 9999)}" if private
            else f"000-{digits(2)}-{digits(4)}",
            "local": f"({r.randrange(200, 999)}) {r.randrange(200, 999)}-{digits(4)}" if private
            else f"{r.choice('01')}{digits(2)}.{r.choice('01')}{digits(2)}.{digits(4)}",
            "name": f"{r.choice(pii.TITLES)} {r.choice(pii.GIVEN_NAMES)} {r.choice(['Tenor', 'Walbrook', 'Quist'])}",
            "written": f"ann{i} [at] mail{i} [dot] {'com' if private else 'x1'}",
        }[kind]
        cue = {"ssn": "social security", "local": "call", "name": "signed", "written": "contact"}[kind]
        other = r.choice(["version", "order", "serial", "model", "tracking", "street"])
        if kind == "name" and not private:
            value = value.split(" ", 1)[1]
        before = cue if private else other
        out.append((i, kind, private, f"prose about nothing {before} {value}, and more prose"))
    return out


def test_reliabilities_and_held_out_accuracy(texts):
    seen, held = labelled(1, 600), labelled(2, 300)
    model = pii.train(pii.candidates(texts({i: t for i, _, _, t in seen})))
    form = pii.LABELERS.index("form")
    ssn = model.votes[form][pii.KINDS.index("ssn")]
    assert ssn[1][pii.YES] > 0.7 and ssn[0][pii.NO] > 0.7
    warning = pii.LABELERS.index("warning")
    assert model.votes[warning][0][0][pii.NO] > 0.6 and model.votes[warning][0][1][pii.NO] < 0.2
    rows = {r["doc_id"]: r["spans"] for r in pii.scan(texts({i: t for i, _, _, t in held}), model).collect()}
    right = Counter(any(s["kind"] == kind for s in rows[i]) == private for i, kind, private, _ in held)
    assert right[True] / len(held) >= 0.95, right
    for i, kind, private, text in held:
        assert all(text[s["start"]:s["end"]].strip() == text[s["start"]:s["end"]] for s in rows[i])


def test_estimation_recovers_planted_reliabilities():
    r = random.Random(3)
    right, counts = [0.95, 0.8, 0.7, 0.85, 0.75], Counter()
    for _ in range(20_000):
        y = r.random() < 0.4
        votes = sum((pii.YES if (r.random() < p) == y else pii.NO) * 3**i for i, p in enumerate(right))
        counts[(0, votes, 0)] += 1
    chances, shares = pii.estimate(sorted((*k, n) for k, n in counts.items()))
    assert shares[0] == pytest.approx(0.4, abs=0.03)
    for (table, *_), p in zip(chances, right):
        assert table[1][pii.YES] == pytest.approx(p, abs=0.03) and table[0][pii.NO] == pytest.approx(p, abs=0.03)


def test_clean_prose_has_no_spans(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    for r in pii.digest(docs).collect():
        assert all(s.split(":")[0] in pii.BASE for s in r["spans"].split(",") if s)


def test_odd_rows(odd, none):
    rows = pii.scan(odd).collect()
    assert len(rows) == odd.count() and {r["place"] for r in rows} == {1} and all(r["spans"] == [] for r in rows)
    assert pii.scan(none).collect() == [] and pii.digest(none).collect() == []
    assert len(pii.digest(odd).collect()) == odd.count()


def test_account_numbers(texts):
    values = {1: "please pay to the account DE89 3704 0044 0532 0130 00 today", 2: "account DE89 3704 0044 0532 0130 01 today",
              3: "IBAN GB82WEST12345698765432"}
    rows = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in pii.scan(texts(values)).collect()}
    assert "iban" in rows[1] and "iban" in rows[3] and "iban" not in rows[2]
