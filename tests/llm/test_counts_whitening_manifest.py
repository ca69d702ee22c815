"""op11, op12 and op13 against the library, numpy and a plain Merkle tree."""
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillon.llm import merkle, whitening, wholetokens
from quillon.llm.tokens import vocabulary_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf int, at int, `uid` long, w long"
BYTES = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def rows():
    texts = ["", None, "the end", "Don't we'll ''s\n\n  x\t1२ …", "<|endoftext|> a\x1cb", "é中文😀 ʼ\x85 y", "q" * 70_000, " ".join(f"wörd{i} of" for i in range(30_000))]
    out = [(i, t, lang, "s" if i % 3 else None, i if i % 4 else None) for i, (t, lang) in
           enumerate(zip(texts * 5, ["en", "de", None, "é", "en", "en", "en"] * 6))]
    return out + [(None, "no id", "en", "s", 3), (7, "same row", "en", "s", 8)] * 40 + [(99, "lone", "zz", "s", 2 ** 63 - 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def test_token_counts_are_the_librarys(docs, no_docs, rows):
    lib = wholetokens.library(vocabulary_path(BYTES))
    want = Counter((i, len((t or "").encode()), n, n > 1024) for (i, t, *_), n in zip(rows, lib([r[1] or "" for r in rows])))
    assert Counter(tuple(r)[:4] for r in wholetokens.token_counts(docs, vocabulary_path(BYTES)).collect()) == want
    assert wholetokens.token_counts(no_docs, vocabulary_path(BYTES)).count() == 0


@pytest.mark.parametrize("name", [BYTES, "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counter_on_random_texts(name, monkeypatch):
    monkeypatch.setattr(wholetokens, "SEGMENT", 12)
    monkeypatch.setattr(wholetokens, "REMEMBERED", 50)
    path, rnd = vocabulary_path(name), random.Random(5)
    counter, lib = wholetokens.Counter(path, wholetokens.prove(path)), wholetokens.library(path)
    alphabet = ["a", "bc", "é", "1", "२", " ", "  ", "\n", "'", "'s", "'ll", "!", "…", " ", "　", "中", "😀", "<|endoftext|>", "the", " of", "\x1c", "​", "Ⅷ"]
    texts = ["".join(rnd.choices(alphabet, k=rnd.randrange(40))) for _ in range(3000)]
    assert [counter.count(t)[0] for t in texts] == lib(texts)


def test_every_proven_string_is_one_token():
    path = vocabulary_path(BYTES)
    proof = wholetokens.prove(path)
    assert len(proof.whole) > 45_000 and " the" in proof.whole and "<|endoftext|>" not in proof.whole
    strings = sorted(proof.whole)
    assert set(wholetokens.library(path)(strings)) == {1}
    counter = wholetokens.Counter(path, proof)
    counter.library = None  # proven strings never reach it
    assert counter.count("the end of the day") == (5, 5)


def _whitened(vectors, weights="counts"):
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors], dtype=object)
    fit = np.array(sorted(set(map(tuple, x))), dtype=object) if weights == "one" else x
    n, sums = len(fit), fit.sum(axis=0)
    mean = np.array([s / n for s in sums])
    centred = (fit - mean).astype(float)
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    order = np.argsort(e)[::-1][:32]
    return n, [int(((n * r - sums) ** 2).sum()) for r in x], (x - mean).astype(float) @ u[:, order] / np.sqrt(e[order]), e[order] / np.trace(cov)


@pytest.mark.parametrize("weights", ["counts", "one"])
def test_whitening(spark, weights):
    rng = np.random.default_rng(2)
    good = [list(map(float, v)) for v in rng.normal(size=(1500, 5)) * [1, 2, 3, 4, 5]] + [[0.5, 1.0, 1.5, 2.0, 2.5]] * 900
    bad = [None, [1.0, None, 2.0, 3.0, 4.0], [float("nan")] * 5, [1.0, 2.0, float("inf"), 0.0, 0.0]]
    table = [(k if k % 50 else None, v, 1, 2, 3) for k, v in enumerate(good + bad)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, x int, k1 int, rows int").repartition(3)
    got = whitening.whitened_rows(df, weights=weights).collect()
    n, deviation, z, explained = _whitened(good, weights)
    assert len(got) == len(good) * 5 and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1
    assert Counter((r.vec_id, r.deviation) for r in got if r.component == 1) == Counter((k if k % 50 else None, d) for k, d in enumerate(deviation))
    sign, first = {}, {k: z[k] for k in range(len(good)) if k % 50}
    for r in got:
        assert abs(r.explained - explained[r.component - 1]) < 1e-9
        if r.vec_id is not None:
            want = first[r.vec_id][r.component - 1]
            sign.setdefault(r.component, np.sign(r.whitened * want))
            assert abs(r.whitened * sign[r.component] - want) < 1e-9
    if weights == "counts":
        assert got[0].identity_error < 1e-9


def test_whitening_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    of = lambda *vs: whitening.whitened_rows(spark.createDataFrame([(k, v) for k, v in enumerate(vs)], schema)).collect()
    assert of() == [] and of(None, [None]) == [] and of([]) == []
    same = of([1.0, 2.0], [1.0, 2.0])
    assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in same] == [(0, None, None, 0.0)] * 4
    short = of([1.0], [1.0, 0.0], [3.0, 0.0], [])  # a short vector ends in entries 0
    assert Counter((r.vec_id, r.component, r.deviation, r.whitened is None) for r in short) == Counter(
        (v, c, d, c == 2) for v, d in ((0, 128 ** 2), (1, 128 ** 2), (2, 256 ** 2)) for c in (1, 2))
    far = of([1e30], [-1e30], [0.0])
    assert [r.deviation for r in sorted(far, key=lambda r: r.vec_id)][:2] == [None, None] and all(r.explained == 1.0 for r in far)


def test_exact_deviation_near_the_limit():
    x = np.array([[0], [1_518_500_249], [1_518_500_250]])
    for n, want in ((1, [0, 1_518_500_249 ** 2, 1_518_500_250 ** 2]), (2, [0, 4 * 1_518_500_249 ** 2, None])):
        assert whitening.deviations(x, n, [0], np.zeros(1)) == want


def _hash(s):
    return hashlib.sha256(s.encode()).hexdigest()


def _field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _plain_tree(hashes):
    """Root, and each leaf's (sibling or None, sibling is left) level by level."""
    paths, nodes = [[] for _ in hashes], [(h, [k]) for k, h in enumerate(hashes)]
    while len(nodes) > 1:
        above = []
        for at in range(0, len(nodes), 2):
            run = nodes[at:at + 2]
            for place, (_, members) in enumerate(run):
                for k in members:
                    paths[k].append((run[1 - place][0] if len(run) == 2 else None, place == 1))
            above.append((_hash("".join(h for h, _ in run)), sum((m for _, m in run), [])))
        nodes = above
    return nodes[0][0], paths


def _plain_manifest(rows):
    langs = defaultdict(list)
    for i, text, lang, source, n in rows:
        leaf = _hash("".join(map(_field, (i, source, lang, n, text))))
        changed = None
        if i is not None and n is not None and zlib.crc32(str(i).encode()) % 7 == 0:
            changed = _hash("".join(map(_field, (i, source, lang, n + 1 if n < 2 ** 63 - 1 else None, text))))
        langs[(lang is not None, (lang or "").encode())].append(((i is not None, i or 0), leaf, i, changed))
    trees = [(sorted(langs[k], key=lambda x: x[:2])) for k in sorted(langs)]
    built = [_plain_tree([x[1] for x in t]) for t in trees]
    root, upper = _plain_tree([b[0] for b in built]) if built else (None, [])
    for tree, (subroot, paths), above in zip(trees, built, upper):
        for (_, leaf, i, changed), path in zip(tree, paths):
            folded = changed or leaf
            for s, left in path + above:
                folded = _hash((s or "") + folded if left else folded + (s or ""))
            yield i, leaf, subroot, root, _hash("".join(s or "" for s, _ in path + above)), folded, folded == root


@pytest.mark.parametrize("stride", [1, 3, 8])
def test_manifest(docs, rows, stride):
    got = merkle.verified_manifest(docs, stride, span=3, broadcast_rows=stride % 2 * 100_000).drop("tampered").collect()
    assert Counter(map(tuple, got)) == Counter(_plain_manifest(rows))
    assert {r.verified for r in got} == {True, False}


@pytest.mark.parametrize("keep", [0, 1, 2, 3, 5, 8, 9])
def test_small_manifests(spark, rows, keep):
    some = [r for r in rows if r[2] == "en"][:keep]
    df = spark.createDataFrame(some, "doc_id long, text string, lang string, source string, n_chars long")
    assert Counter(map(tuple, merkle.verified_manifest(df, 2).drop("tampered").collect())) == Counter(_plain_manifest(some))


def test_climb_leaves_the_sessions_row_bound(spark, docs):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    merkle.verified_manifest(docs)
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before
