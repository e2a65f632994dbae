import hashlib
import random

import pyarrow as pa

from quillmark.llm import fingerprints


def jaccard(a, b):
    keys = set(a) | set(b)
    w = lambda c, k: c.get(k, 0) * len(k)
    most = sum(max(w(a, k), w(b, k)) for k in keys)
    return sum(min(w(a, k), w(b, k)) for k in keys) / most if most else 1.0


def test_edited_texts_and_likeness(spark):
    rng = random.Random(5)
    rows = [(k * 7 % 101, " ".join(f"w{rng.randrange(200)}" for _ in range(rng.choice([0, 1, 3, 50, 400])))) for k in range(101)]
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    ordered = sorted(rows)
    assert len(got) == 101
    off = []
    for (k, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        r = got[k]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == fingerprints.fingerprint(text) and r.edited_fingerprint == fingerprints.fingerprint(edited)
        off.append(r.near_edited - jaccard(fingerprints.terms(text), fingerprints.terms(edited)))
        assert 0 <= r.near_next <= 1
    assert abs(sum(off) / len(off)) < 0.03 and max(map(abs, off)) < 0.25


def test_collision_rate_is_generalised_jaccard():
    s = fingerprints.sampler()
    rng = random.Random(6)
    errors = []
    for _ in range(60):
        a = fingerprints.Counter({f"t{i}": rng.randrange(1, 30) for i in range(40)})
        b = fingerprints.Counter({k: max(1, n + rng.randrange(-8, 9)) for k, n in a.items() if rng.random() < 0.8})
        x = s.signatures([a, b])
        errors.append(fingerprints.likeness(x[0], x[1], True, True) - jaccard(a, b))
    assert abs(sum(errors) / 60) < 0.02 and max(map(abs, errors)) < 0.2


def test_odd_rows(spark, odd_docs, no_docs):
    got = fingerprints.edited_fingerprints(odd_docs).collect()
    assert len(got) == odd_docs.count() and fingerprints.edited_fingerprints(no_docs).count() == 0
    assert len({r.fingerprint for r in got if r.doc_id == 1}) == 1
    one = fingerprints.edited_fingerprints(odd_docs.where("doc_id = 4")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_short_rows_are_held_in_bounded_parts():
    """Rows without text count as rows do; every row that is no guest stands before its next row in one part."""
    batch = lambda k, guest: pa.RecordBatch.from_pylist([{"range": k, "guest": guest, "doc_id": i, "text": "" if k else "ab"} for i in range(1 if guest else 9_000)])
    found = list(fingerprints.parts([batch(0, 0), batch(0, 1), batch(1, 0), batch(1, 1)]))
    assert max(map(len, found)) <= fingerprints.PART_ROWS + 1
    pairs = [(a, b) for part in found for a, b in zip(part, part[1:]) if not a[1]]
    assert [a[:3] for a, _ in pairs] == [(k, 0, i) for k in (0, 1) for i in range(9_000)]
    assert all(b[:3] == ((a[0], 0, a[2] + 1) if a[2] < 8_999 else (a[0], 1, 0)) for a, b in pairs)


def test_sampler_keeps_few_letters_and_rows():
    """Long words and documents of many words leave the sampler's memory as it was, and have their likeness."""
    s = fingerprints.Sampler()
    room = s.kept.nbytes
    long = [fingerprints.terms(f"{'x' * 5_000}{k} tail") for k in range(50)]
    x = s.signatures(long)
    assert sum(len(w) for w, _ in s.place) < 5_000 and (x == s.signatures(long)).all()
    many = fingerprints.Counter({f"w{k}": 1 + k % 3 for k in range(80_000)})
    half = fingerprints.Counter(dict(list(many.items())[:40_000]))
    a, b, none = s.signatures([many, half, fingerprints.Counter()])
    assert s.kept.nbytes == room and not none.any()
    assert (a == fingerprints.Sampler().signatures([many])[0]).all()
    assert abs(fingerprints.likeness(a, b, True, True) - jaccard(many, half)) < 0.2


def test_first_rows_of_ranges_are_found_without_sorting_texts(spark):
    """The table's texts are not aggregated for the first row of each range: only rows of the ids that begin one are."""
    rows = [(None, "b"), (None, "a"), (4, "d"), (4, "c"), (9, "e")] + [(k, f"t{k}") for k in range(10, 60)]
    df = fingerprints.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    aggregates = [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in x]
    assert aggregates and all("min(text" in x and "struct" not in x for x in aggregates)
    got = {(r.doc_id, r.n_chars, r.edited_sha256) for r in df.collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = set()
    for (k, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        cut = len(t) // 4
        want.add((k, len(t), hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()))
    assert got == want
