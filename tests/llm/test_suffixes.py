import hashlib
import random

import pytest
from helpers import SF, awkward, documents, nothing, texts_of

from tickloom.llm import queries, suffixes


def brute(rows):
    """{doc_id: [(bytes, removed, spans, kept)]} from a table of the first document of every window."""
    first = {}
    order = lambda i: (i is None, i or 0)
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            first[w] = min(order(i), first.get(w, order(i)))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < order(i):
                gone[k : k + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in df.collect()), key=repr)


def test_equals_a_table_of_windows(spark):
    docs = documents(spark)
    assert got(suffixes.remove_repeats(docs)) == brute(texts_of(docs))


@pytest.mark.parametrize("seed", [1, 2])
def test_shifted_overlapping_and_periodic_repeats(spark, seed):
    rng = random.Random(seed)
    letters = lambda n, alphabet="abcd": "".join(rng.choice(alphabet) for _ in range(n))
    parts = [letters(rng.randrange(40, 160)) for _ in range(6)] + ["a" * 70, "ab" * 60, "é" * 40]
    rows = [(n, "".join(rng.choice(parts)[rng.randrange(0, 20) :] if rng.random() < 0.7 else letters(30) for _ in range(rng.randrange(0, 6)))) for n in range(120)]
    assert got(suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_awkward_documents(spark):
    docs = awkward(spark)
    assert got(suffixes.remove_repeats(docs)) == brute(texts_of(docs))
    assert suffixes.remove_repeats(nothing(spark)).count() == 0


def test_query_returns_a_digest(spark):
    out = queries.op6_suffix_dedup(spark, SF)
    assert {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"} == set(out.columns)


def test_loser_tree_merges_in_order():
    rng = random.Random(4)
    runs, rows = [], []
    for _ in range(7):
        words = sorted({bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(1, 20))})
        shared = [0] + [next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b))) for a, b in zip(words, words[1:], strict=False)]
        row = {"prefix": bytes(shared), "size": bytes(map(len, words)), "rest": b"".join(w[s:] for w, s in zip(words, shared, strict=True)), "left_size": b"", "left": b"", "docs": suffixes.small(suffixes.np.arange(len(words))), "number": len(words)}
        runs.append(suffixes.Run(row))
        rows.append(words)
    out = [(shared, rows[k][n]) for shared, k, n in suffixes.merged(runs)]
    assert [w for _, w in out] == sorted(w for words in rows for w in words)
    common = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    assert [s for s, _ in out][1:] == [common(a, b) for (_, a), (_, b) in zip(out, out[1:], strict=False)]


@pytest.mark.parametrize("seed", [3, 4])
def test_negative_ids(spark, seed):
    rng = random.Random(seed)
    parts = ["".join(rng.choice("abcdefgh") for _ in range(90)) for _ in range(5)]
    ids = [-1, -(2**62), -300, 0, 1, 2, 7, 200, None]
    rows = [(i, "".join(rng.choice(parts)[rng.randrange(0, 20) :] for _ in range(3))) for i in ids]
    assert got(suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_small_numbers_read_back():
    for values in ([], [0, 255], [-1], [-1, 3], [-(2**63), 2**63 - 1], [70_000, 2]):
        assert suffixes.unsmall(suffixes.small(suffixes.np.array(values, suffixes.np.int64))).tolist() == values


def test_windows_of_few_and_of_many_suffixes_agree(monkeypatch):
    rng, anchor = random.Random(5), b"an anchor of 20 byte"
    text = lambda n: bytes(rng.choice(b"ab") for _ in range(n))
    classes = {}
    for _ in range(400):
        right = anchor + (b"same end of a passage in all of " + text(30))[: rng.randrange(31)]
        classes[right, (text(2) + b"and what stands before an anchor" + text(30))[: rng.randrange(31)]] = rng.randrange(9)
    monkeypatch.setattr(suffixes, "FEW", 10**9)
    few = suffixes._earlier(classes)
    monkeypatch.setattr(suffixes, "FEW", 0)
    assert suffixes._earlier(classes) == few and any(few)


@pytest.mark.parametrize("seed", [6, 7])
def test_anchors_split_into_parts_give_the_same(spark, seed, monkeypatch):
    rng = random.Random(seed)
    line = "this line of a licence stands in every document, at its start, its end or twice"
    letters = lambda n: "".join(rng.choice("ab c") for _ in range(n))
    rows = [(n, letters(rng.randrange(9)) + line[rng.randrange(12) :] + letters(rng.randrange(60)) + (line if n % 3 else line[:70])) for n in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 2_000)
    expected = brute(rows)
    for heavy in (0, 20, 10**9):
        monkeypatch.setattr(suffixes, "HEAVY", heavy)
        assert got(suffixes.remove_repeats(docs)) == expected


def test_a_heavy_anchor_is_many_buckets():
    rng = random.Random(8)
    texts = [bytes(rng.choice(b"abcdefgh") for _ in range(60)).decode() + "a line that every document holds" + bytes(rng.choice(b"abcdefgh") for _ in range(60)).decode() for _ in range(400)]
    block = suffixes.Block(suffixes.pa.table({"doc_id": range(400), "text": texts}), 16)
    sent = block.anchors(0)
    most = {}
    for heavy in (False, True):
        bits = lambda r, v: suffixes.np.packbits(suffixes.np.full(r["number"], v)).tobytes()
        shared = [{k: r[k] for k in ("bucket", "number")} | {"mask": bits(r, True), "heavy": bits(r, heavy)} for r in sent]
        sizes = [sum(row["prefix"][n] >= suffixes.KMER for n in range(row["number"])) for row in block.runs(0, shared)]
        most[heavy] = max(sizes)
    assert most[True] < most[False] / 2
