"""Each operator against brute force, and its edge cases: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from casenet.llm import byte_bpe, chat_format, exact_dedup, linemodel, minhash_dedup, packing, quality_classifier, quality_rules, suffix_dedup, textkernel, token_counts, toxicity
from casenet.plans.shared import SharedTables

DOCS = "doc_id bigint, text string, lang string, n_chars bigint, score double, ids array<int>, n_tokens bigint, kept boolean, component_id string, held_out string, predicted string, name string, place string"
LABELS = "doc_id bigint, quality int, toxic int"
SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", None if t is None else len(t), 1.5, [9], 3, False, "c", "h", "p", "n", "q") for i, t in rows], DOCS)


def prose(seed, n, vocabulary=4000):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}{'.' if k % 9 == 8 else ''}" for k in range(n))


def messy_rows():
    long_text = "\n".join(prose(s, 400) for s in range(60))
    base = prose(1, 120)
    return [(0, None), (1, ""), (2, " \n\t "), (3, base), (4, base), (4, base), (5, base.replace(" ", "  ")), (6, long_text), (7, "x" * 70_000), (8, "one"), (9, "naïve Ünïcödé \U0001f600 text here ok"), (None, "no id here"), (10, "A # $ % & | < >\nA # $ % & | < >"), (11, base + " tail words here")]


@pytest.fixture(scope="module")
def messy(spark):
    return documents(spark, messy_rows())


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [(1, "x")]).limit(0)


@pytest.fixture(scope="module")
def labelled(spark):
    """Clean prose, shouted junk and toxic texts with labels."""
    rng, rows, labels = random.Random(7), [], []
    for i in range(260):
        kind = i % 4
        text = "\n".join(prose(1000 + i * 10 + k, rng.randint(20, 60)) for k in range(4))
        if kind == 0:
            text = text.split("\n")[0] + "\n" + "\n".join(" ".join(f"{w.upper()}!!" for w in line.split()) for line in text.split("\n")[1:])
        if kind == 1:
            words = text.split(" ")
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["grotbag", "snarkle", "vilefax"]))
            text = " ".join(words)
        rows.append((i, text))
        labels.append((i, int(kind != 0), int(kind == 1)))
    return documents(spark, rows), spark.createDataFrame(labels, LABELS)


def no_labels(spark):
    return spark.createDataFrame([], LABELS)


# 1 and 6 -------------------------------------------------------------------


@pytest.mark.parametrize("block", [1, 2, 3, linemodel.BLOCK])
def test_forward_backward_and_viterbi_against_enumeration(block):
    rng = np.random.default_rng(3)
    lengths = [1, 4, 2, 6]
    first = np.concatenate([[0], np.cumsum(lengths)])
    unary, step = rng.normal(size=first[-1]), rng.normal(size=(2, 2))
    p, steps, log_z = linemodel.forward_backward(step, unary, first, block)
    best = linemodel.viterbi(step, unary, first, block)
    want_steps, want_z = np.zeros((2, 2)), 0.0
    for d, n in enumerate(lengths):
        u = unary[first[d] : first[d + 1]]
        paths = list(itertools.product((0, 1), repeat=n))
        scores = np.array([sum(u[k] * y[k] for k in range(n)) + sum(step[a, b] for a, b in zip(y, y[1:], strict=False)) for y in paths])
        z = np.logaddexp.reduce(scores)
        want_z += z
        weight = np.exp(scores - z)
        assert np.allclose(p[first[d] : first[d + 1]], sum(w * np.array(y) for w, y in zip(weight, paths, strict=True)))
        for w, y in zip(weight, paths, strict=True):
            for a, b in zip(y, y[1:], strict=False):
                want_steps[a, b] += w
        assert tuple(best[first[d] : first[d + 1]]) == paths[int(scores.argmax())]
    assert np.allclose(steps, want_steps)
    assert log_z == pytest.approx(want_z)


def test_long_documents_are_labelled_as_whole():
    rng = np.random.default_rng(4)
    first = np.cumsum([0, 1, 4000, 30, 2 * linemodel.BLOCK])
    unary, step = 3 * rng.normal(size=first[-1]), np.array([[0.5, -1.0], [-0.7, 0.9]])
    for by_block, whole in zip(linemodel.forward_backward(step, unary, first), linemodel.forward_backward(step, unary, first, 4000), strict=True):
        assert np.allclose(by_block, whole)
    assert (linemodel.viterbi(step, unary, first) == linemodel.viterbi(step, unary, first, 4000)).all()
    assert len(linemodel.viterbi(step, unary[:0], first[:1])) == len(linemodel.forward_backward(step, unary[:0], first[:1])[0]) == 0


def test_quality_on_held_out_documents(labelled):
    docs, labels = labelled
    rows = quality_classifier.classify(docs, labels).select("doc_id", "held_out", "score", "predicted").join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    unseen = [r for r in rows if r["held_out"]]
    assert len(unseen) > 30
    assert np.mean([r["predicted"] == r["quality"] for r in unseen]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_quality_edges(spark, messy, empty, labelled):
    for labels in (labelled[1], no_labels(spark)):
        rows = quality_classifier.classify(messy, labels).collect()
        assert len(rows) == len(messy_rows())
        assert all(r["score"] is not None and r["predicted"] is not None for r in rows)
        assert quality_classifier.classify(empty, labels).count() == 0
    kept = quality_classifier.keep_good(messy, labelled[1])
    assert kept.schema == messy.schema
    assert {r["name"] for r in kept.collect()} <= {"n"}


def base_rules(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else None
    if twice is None:
        seen, twice = set(), set()
        for w in windows:
            (twice if w in seen else seen).add(w)
    inside = set().union(*(range(i, i + 8) for i, w in enumerate(windows) if w in twice)) if twice else set()
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_rules_against_brute_force(spark, messy, empty, labelled):
    extra = [(100 + s, "\n".join([prose(s, 30, 40), prose(s, 30, 40), prose(s + 1, 12, 5), "a  b", "a b", "a  b"])) for s in range(12)]
    docs = messy.unionByName(documents(spark, extra))
    rows = quality_rules.apply_rules(docs, labelled[1]).collect()
    texts = {}
    for i, t in messy_rows() + extra:
        texts[i] = t
    assert len(rows) == len(messy_rows()) + len(extra)
    for r in rows:
        want = base_rules(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["kept"] and r["base_failed"])
    assert quality_rules.apply_rules(empty, labelled[1]).count() == 0


def test_rules_keep_content_and_drop_junk(labelled):
    docs, labels = labelled
    rows = quality_rules.apply_rules(docs, labels).join(labels, "doc_id").collect()
    assert np.mean([r["kept"] for r in rows if r["quality"] == 1]) > 0.95
    assert np.mean([r["kept"] for r in rows if r["quality"] == 0]) < 0.05


# 2 --------------------------------------------------------------------------


def test_boundaries_are_optimal():
    rng = random.Random(2)
    for _ in range(25):
        lengths = sorted(rng.sample(range(1, 60), rng.randint(1, 8)))
        counts = [rng.randint(1, 9) for _ in lengths]
        totals = [n * c for n, c in zip(lengths, counts, strict=True)]
        for k in (1, 2, 3, 5):
            ends, padding = packing.boundaries(np.array(lengths), np.array(counts), np.array(totals), k)
            cost = lambda cut: sum((next(e for e in cut if e >= n) - n) * c for n, c in zip(lengths, counts, strict=True))  # noqa: E731, B023
            best = min(cost(sorted({*c, lengths[-1]})) for r in range(k) for c in itertools.combinations(lengths[:-1], r))
            assert padding == best == cost(list(ends))
            assert len(ends) <= k


def test_packing(messy, empty):
    rows = packing.pack(messy, n_buckets=4, token_budget=500, group_rows=4).collect()
    assert len(rows) == len(messy_rows())
    lengths = sorted(len(WORD.findall(t or "")) for _, t in messy_rows())
    assert sorted(r["n_tokens"] for r in rows) == lengths
    for key, group in itertools.groupby(sorted(rows, key=lambda r: r["batch_id"]), key=lambda r: r["batch_id"]):
        group = list(group)
        assert len({r["bucket"] for r in group}) == 1, key
        assert len(group) == 1 or len(group) * group[0]["bucket_tokens"] <= 500
        assert sorted(r["row_in_batch"] for r in group) == list(range(len(group)))
        assert all(r["padding"] == r["bucket_tokens"] - r["n_tokens"] >= 0 for r in group)
    assert packing.pack(empty).count() == 0


def test_packing_by_a_given_length(messy):
    assert {r["n_tokens"] for r in packing.pack(messy, length=F.lit(5)).collect()} == {5}


def test_packing_is_exact_on_long_texts(spark):
    """Bucket ends of lengths beyond any fine grid leave the least padding, by trying all of them."""
    lengths = [10, 4097, 4099, 5000, 5001, 5003, 9000, 9001, 20000, 20011]
    docs = spark.createDataFrame([(i % 3, "", n) for i, n in enumerate(lengths)], "doc_id bigint, text string, n bigint")
    rows = packing.pack(docs, length=F.col("n"), n_buckets=4, group_rows=2).collect()
    cost = lambda ends: sum(min(e for e in ends if e >= n) - n for n in lengths)
    best = min(cost([*some, 20011]) for some in itertools.combinations(lengths[:-1], 3))
    assert sum(r["padding"] for r in rows) == best and len(rows) == len(lengths)


def test_token_lengths(messy):
    enc = byte_bpe.encoding(BPE, public_tokenizers.PATTERN)
    rows = byte_bpe.count_tokens(messy.select("doc_id", "text", "n_tokens", "lang"), BPE, public_tokenizers.PATTERN).collect()
    want = [(i, len(enc.encode_ordinary(t or ""))) for i, t in messy_rows()]
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in rows), key=str) == sorted(want, key=str)


# 3 --------------------------------------------------------------------------


def test_toxicity_on_held_out_documents(labelled):
    docs, labels = labelled
    rows = toxicity.classify(docs, labels).join(labels.withColumnRenamed("toxic", "label"), "doc_id").collect()
    unseen = [r for r in rows if r["held_out"]]
    assert np.mean([r["toxic"] == bool(r["label"]) for r in unseen]) > 0.9
    assert all(0 <= r[c] <= 1 for r in rows for c in ("p_toxic", "p_first", "p_second"))


def test_chain_feeds_earlier_categories_forward():
    rng = np.random.default_rng(0)
    x = np.column_stack([rng.integers(0, 2, 400), np.ones(400)])
    first = (x[:, 0] > 0) ^ (rng.random(400) < 0.1)
    weights, unseen = toxicity.fit_chain(x, np.column_stack([first, first]).astype(float), np.arange(400) % 5)
    assert [len(w) for w in weights] == [2, 3]
    p = toxicity.predict(weights, x)
    assert p.shape == unseen.shape == (400, 2)
    assert abs(weights[1][0]) > 0.1


def test_features_against_a_plain_version():
    """Words and beginnings by their bytes: equal features share a bucket, and each document has those of its own words."""
    import pyarrow as pa

    texts = ["idiots, idiot (idiotic)", "Straße naïve idiot", "", "a bb ccc dddd", "!!! ---"]
    (_, _, data, offsets) = next(iter(textkernel.chunks(pa.array(texts))))
    doc, _, bucket = toxicity.features(data, offsets)
    plain = []
    for d, text in enumerate(texts):
        for word in re.sub(r"[!-/:-@\[-`{-~]", " ", text).split():
            raw = word.encode()
            plain += [(d, ("word", raw)), *((d, (size, raw[:size])) for size in toxicity.PREFIXES if len(raw) >= size)]
    assert sorted(doc.tolist()) == sorted(d for d, _ in plain)
    names = {}
    for d, name in plain:
        names.setdefault(name, []).append(d)
    found = {}
    for d, b in zip(doc.tolist(), bucket.tolist(), strict=True):
        found.setdefault(b, []).append(d)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, names.values()))


def test_selected_features_are_pairs_of_document_and_column():
    import pyarrow as pa

    texts = ["bad bad words", "fine words", ""]
    (_, _, data, offsets) = next(iter(textkernel.chunks(pa.array(texts))))
    doc, _, bucket = toxicity.features(data, offsets)
    column = np.full(1 << toxicity.BITS, -1, dtype=np.int16)
    some = sorted(set(bucket[doc == 0].tolist()))[:2]
    column[some] = [0, 1]
    want = sorted({(d, int(column[b])) for d, b in zip(doc.tolist(), bucket.tolist(), strict=True) if b in some})
    assert list(map(tuple, toxicity.selected(data, offsets, column).tolist())) == want


def test_terms_of_one_family_take_one_side():
    """Columns 0 and 1 always together, 2 and 3 together, 4 alone, 5 no term."""
    rows = [(1, 1, 0, 0, 0, 1)] * 6 + [(0, 0, 1, 1, 0, 0)] * 4 + [(0, 0, 0, 0, 1, 1)] * 3 + [(1, 1, 0, 0, 1, 0)]
    side = toxicity.sides_of(np.array(rows), np.array([True] * 5 + [False]))
    assert side.tolist() == [0, 0, 1, 1, 1, -1]
    assert toxicity.sides_of(np.zeros((0, 3)), np.zeros(3, dtype=bool)).tolist() == [-1, -1, -1]


def test_a_chain_tells_more_than_a_lone_model():
    """The verdict needs either of two conjunctions, each of which an earlier category learns with its own terms."""
    rng = np.random.default_rng(2)
    pairs = np.array([(i, c) for i in range(600) for c in np.flatnonzero(rng.random(12) < 0.3)])
    x = toxicity._design(pairs, 600, 12)
    sides = [x[:, :5].sum(axis=1) >= 3, x[:, 5:10].sum(axis=1) >= 3]
    y = np.column_stack([*sides, sides[0] | sides[1]]).astype(float)
    fold = toxicity.folds_of(pairs, 600, 5)
    chained, alone = toxicity.fit_chain(x, y, fold)[1][:, -1], toxicity.fit_chain(x, y[:, -1:], fold)[1][:, -1]
    assert toxicity.log_loss(chained, y[:, -1]) < 0.9 * toxicity.log_loss(alone, y[:, -1])


def newton(x, y):
    """Ridge logistic regression by plain Newton steps."""
    w = np.zeros(x.shape[1])
    if y.min() == y.max():
        w[-1] = 6.0 if y[0] else -6.0
        return w
    for _ in range(40):
        p = 1 / (1 + np.exp(-x @ w))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (y - p) - w)
    return w


def test_chain_against_brute_force():
    """Every link and every out-of-fold probability, by Newton's method, row by row of the folds."""
    rng = np.random.default_rng(3)
    pairs = np.array([(i, c) for i in range(90) for c in np.flatnonzero(rng.random(4) < 0.4)])
    x = toxicity._design(pairs, 90, 4).astype(float)
    noise = rng.random((90, 3)) < 0.15
    y = (np.column_stack([x[:, 0] > 0, x[:, 1] > 0, x[:, 0] + x[:, 2] > 0]) ^ noise).astype(float)
    fold = toxicity.folds_of(pairs, 90, 3)
    weights, unseen = toxicity.fit_chain(x, y, fold)
    before, design = [], x
    for k in range(3):
        assert weights[k] == pytest.approx(newton(design, y[:, k]), abs=1e-3)
        out = np.array([1 / (1 + np.exp(-design[i] @ newton(design[fold != fold[i]], y[fold != fold[i], k]))) for i in range(90)])
        assert unseen[:, k] == pytest.approx(out, abs=1e-3)
        before.append(out)
        design = np.column_stack([*before, x])
    alike = {}
    for i in range(90):
        alike.setdefault(tuple(x[i]), set()).add(int(fold[i]))
    assert all(len(f) == 1 for f in alike.values()) and len(set(fold.tolist())) == 3


def test_threshold_tells_labels_apart():
    p, y = np.array([0.1, 0.2, 0.3, 0.8, 0.9, 0.35]), np.array([0, 0, 0, 1, 1, 0])
    assert toxicity.best_threshold(p, y) == pytest.approx((0.35 + 0.8) / 2)
    assert toxicity.best_threshold(p, np.zeros(6)) == float("inf")
    rng = np.random.default_rng(1)
    p, y = rng.random(200).round(2), rng.integers(0, 2, 200)
    rate = lambda t: np.mean(p[y == 1] >= t) - np.mean(p[y == 0] >= t)
    assert rate(toxicity.best_threshold(p, y)) == pytest.approx(max(rate(t) for t in np.arange(0, 1.01, 0.005)))


def test_toxicity_edges(spark, messy, empty, labelled):
    for labels in (labelled[1], no_labels(spark)):
        assert toxicity.classify(messy, labels).count() == len(messy_rows())
        assert toxicity.classify(empty, labels).count() == 0
    assert not any(r["toxic"] for r in toxicity.classify(messy, no_labels(spark)).collect())


# 4 --------------------------------------------------------------------------


def test_byte_bpe_round_trip(messy, empty):
    enc = byte_bpe.encoding(BPE, public_tokenizers.PATTERN)
    rows = byte_bpe.round_trip_digests(messy, BPE, public_tokenizers.PATTERN).collect()
    texts = dict(messy_rows())
    assert len(rows) == len(messy_rows())
    for r in rows:
        text = texts[r["doc_id"]] or ""
        ids = enc.encode_ordinary(text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert byte_bpe.round_trip_digests(empty, BPE, public_tokenizers.PATTERN).count() == 0
    whole = byte_bpe.decode(byte_bpe.encode(messy, BPE, public_tokenizers.PATTERN), BPE, public_tokenizers.PATTERN)
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in whole.collect())


ALPHABET = ["a", "Zz", "9", "!", "'", "'s", "'ll", "(", " ", "  ", "\n", "\t ", "é", "\xa0", "\u2003", "\U0001f600", "\x1c", "\x85", "漢字", "か", "。", "ж", "²", "Ⅷ", "_"]


def test_safe_parts_change_no_ids():
    enc, whole = (byte_bpe.encoding(BPE, p) for p in (public_tokenizers.PATTERN, byte_bpe._ONE_PIECE))
    rng = random.Random(4)
    for k in range(400):
        text = "".join(rng.choice(ALPHABET) * rng.choice([1, 1, 1, 2, 9]) for _ in range(150))
        want = enc.encode_ordinary(text)
        for size in (5, 17):
            parts = list(byte_bpe.safe_parts(text, size))
            assert "".join(parts) == text
            assert [i for p in parts for i in enc.encode_ordinary(p)] == want
            split = list(byte_bpe.pieces(text, size))
            assert "".join(p for _, p in split) == text
            assert [i for one, p in split for i in (whole if one else enc).encode_ordinary(p)] == want
            assert byte_bpe.encode_text(BPE, public_tokenizers.PATTERN, text, size) == want


@pytest.mark.parametrize("text", [" " * 5_000_000, "\n" * 5_000_000 + "x", "a" + " \n" * 1_500_000 + " b", "漢字仮名交じり文" * 50_000, "line\n" * 250_000, "word,word" * 120_000, "a" * 1_000_000, "x 1" + "\t" * 70_000 + "y" + " " * 200_000])
def test_texts_of_any_length_are_encoded(text):
    ids = byte_bpe.encode_text(BPE, public_tokenizers.PATTERN, text)
    enc = byte_bpe.encoding(BPE, public_tokenizers.PATTERN)
    assert enc.decode_bytes(ids) == text.encode()
    if not re.search(r"\s{300000}", text):  # the library does not survive longer runs in one call
        assert ids == enc.encode_ordinary(text)


# 5 --------------------------------------------------------------------------


def shared_passages(spark):
    """Documents around a planted passage of 51 to 90 words, at the ends and in the middle."""
    rng, rows = random.Random(11), []
    passages = [prose(5000 + k, 51 + 13 * k) for k in range(4)]
    for i in range(60):
        parts = [prose(9000 + i * 7 + k, rng.randint(0, 80)) for k in range(2)]
        rows.append((i, f"{parts[0]} {passages[i % 4]}\n{parts[1]}" if i % 3 else prose(20000 + i, 150)))
    rows += [(100, passages[0]), (101, "Head " + passages[1].replace(" ", "   ")), (102, " ".join(["The"] * 200)), (103, " ".join(["The"] * 150))]
    return rows


def repeated_50(rows):
    """Words of each document that lie in 50 words in a row that stand in an earlier document, or 50 words before in their own."""
    seen, need = {}, {}
    for i, text in sorted((i, t) for i, t in rows if i is not None):
        words = WORD.findall(text or "")
        for k in range(len(words) - 49):
            at, place = seen.setdefault(tuple(words[k : k + 50]), (i, k))
            if at != i or k - place >= 50:
                need.setdefault(i, set()).update(range(k, k + 50))
    return need


def found_words(found):
    words = {}
    for r in found.collect():
        assert r["source_id"] <= r["doc_id"] and r["n_words"] == r["end_word"] - r["start_word"] >= 50
        assert r["within"] == (r["source_id"] == r["doc_id"])
        words.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    return words


def test_passages_against_brute_force(spark):
    rows = shared_passages(spark)
    assert found_words(suffix_dedup.repeated_passages(documents(spark, rows))) == repeated_50(rows)


def test_passages_of_exactly_the_least_length(spark):
    rows = []
    for k in range(30):
        passage, own = prose(80000 + k, 50), [prose(81000 + 10 * k + n, 3 + 7 * (k % 4)) for n in range(4)]
        rows += [(2 * k, f"{own[0]} {passage} {own[1]}"), (2 * k + 1, f"{own[2]} {passage} {own[3]}")]
    found = found_words(suffix_dedup.repeated_passages(documents(spark, rows)))
    assert found == repeated_50(rows) and len(found) == 30


def test_passages_within_one_document(spark):
    passages = [prose(90000 + k, 50 + 40 * k) for k in range(5)]
    rows = [(k, f"{prose(91000 + k, 20)} {p} {prose(92000 + k, 3 * k)} {p}\n{p}") for k, p in enumerate(passages)]
    rows += [(10, " ".join(passages[0].split()[:30] * 5)), (11, " ".join(passages[1].split()[:49] * 2))]
    found = suffix_dedup.repeated_passages(documents(spark, rows))
    assert found_words(found) == repeated_50(rows)
    assert all(r["within"] for r in found.where("doc_id < 5").collect())
    assert all(r["text"] == dict(rows)[r["doc_id"]] for r in suffix_dedup.drop_repeats(documents(spark, [*rows[5:], rows[5]])).where("doc_id = 11").collect())


def test_rows_of_one_id_are_cut_apart(spark):
    """Different texts of one id have passages of their own, and repeated rows are no repeats of each other."""
    passage, other = prose(93000, 80), prose(93001, 100)
    rows = [(1, f"{other} {passage}"), (1, f"{other} {passage}"), (2, f"{passage} tail one"), (2, f"quite another {prose(93002, 120)}"), (None, f"{passage} no id")]
    left = sorted((r["text"] for r in suffix_dedup.drop_repeats(documents(spark, rows)).collect()), key=len)
    assert left == sorted([rows[0][1], rows[0][1], "tail one", rows[3][1], rows[4][1]], key=len)


def test_nested_passages_against_brute_force(spark):
    """The middle of a passage stands earlier with other surroundings, in another document or in the source itself."""
    rows = []
    for k in range(40):
        whole = prose(50000 + k, 60 + k % 7).split()
        low, size = k % 12, 40 + k % 9
        own = [prose(60000 + 10 * k + n, 30) for n in range(8)]
        middle, whole = f"{own[0]} {' '.join(whole[low : low + size])} {own[1]}", f"{own[2]} {' '.join(whole)} {own[3]}"
        rows += [(10 * k, middle), (10 * k + 1, whole)] if k % 2 else [(10 * k, f"{middle} {whole}")]
        rows.append((10 * k + 2, f"{own[4]} {' '.join(whole.split()[30:-30])} {own[5]}"))
    assert found_words(suffix_dedup.repeated_passages(documents(spark, rows))) == repeated_50(rows)


def test_passages_of_repeated_phrases(spark):
    """Texts that say one phrase again and again, with other words before, between and behind."""
    rows = []
    for k, period in enumerate((1, 2, 5, 11, 17, 30, 39, 41, 60)):
        phrase = prose(700 + k, period).split()
        for j, times in enumerate((9, 4, 6)):
            turns = " ".join((phrase * (times * 60 // period + 1))[: times * 13 + period])
            own = [prose(30000 + 100 * k + 10 * j + n, 15) for n in range(3)]
            rows.append((3 * k + j, " ".join([own[0], turns, own[1], *[turns] * (j == 0), own[2]])))
    found = {}
    for r in suffix_dedup.repeated_passages(documents(spark, rows)).collect():
        found.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    assert found == repeated_50(rows)


def test_repeats_are_cut_once(spark):
    rows = shared_passages(spark)
    docs = documents(spark, rows)
    left = suffix_dedup.drop_repeats(docs)
    assert left.schema == docs.schema
    kept = {r["doc_id"]: r for r in left.collect()}
    assert 100 not in kept and 0 in kept
    assert all(r["n_chars"] == len(r["text"]) for r in kept.values())
    assert all(kept[i]["text"] == t for i, t in rows if i not in repeated_50(rows))
    assert not repeated_50([(i, r["text"]) for i, r in kept.items()])


def test_short_matches_do_not_add_up(spark):
    """40 words of one document and 40 of another are no passage that a document holds."""
    a, b = prose(70001, 200).split(), prose(70002, 200).split()
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, f"{prose(70003, 60)} {' '.join(a[50:95])} {' '.join(b[80:125])} {prose(70004, 60)}")]
    assert suffix_dedup.repeated_passages(documents(spark, rows)).count() == 0
    assert {r["doc_id"]: r["text"] for r in suffix_dedup.drop_repeats(documents(spark, rows)).collect()} == dict(rows)


def test_passage_edges(messy, empty):
    left = suffix_dedup.drop_repeats(messy)
    texts = {r["doc_id"]: r["text"] for r in left.collect()}
    assert texts[0] is None and texts[3] == dict(messy_rows())[3] and 4 not in texts and None in texts
    assert texts[11].split() == ["tail", "words", "here"]
    assert suffix_dedup.repeated_passages(empty).count() == 0
    assert suffix_dedup.drop_repeats(empty).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.repeated_passages(empty, min_words=20)


# 7 --------------------------------------------------------------------------


def test_exact_dedup(spark, messy, empty):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    rows = exact_dedup.deduplicate(messy, index).collect()
    groups = {}
    for i, t in messy_rows():
        groups.setdefault(SPACE.sub(" ", t or ""), []).append(i)
    assert len(rows) == len(messy_rows())
    for r in rows:
        same = next(v for k, v in groups.items() if hashlib.sha256(k.encode()).hexdigest() == r["text_sha256"])
        smallest = min((i for i in same if i is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (smallest, len(same), r["doc_id"] == smallest)
    again = exact_dedup.deduplicate(documents(spark, [(50, "one"), (51, "fresh text"), (1, "fresh  text")]), index).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["is_new"]) for r in again) == [(1, 1, 2, True, True), (50, 8, 2, False, False), (51, 1, 2, False, True)]
    assert exact_dedup.deduplicate(empty, index).count() == 0
    assert index.read().count() == len(groups) + 2 and index.groups().count() == len(groups) + 1
    assert spark.read.parquet(index.path).count() == len(groups) + 2
    both = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.look_up(documents(spark, [(8, "one"), (50, "one"), (1, "fresh  text")]), index).collect()}
    assert both == {(8, 8, 2, True), (50, 8, 2, False), (1, 1, 2, True)}
    index.close()


def test_a_batch_given_again_is_judged_as_at_first(spark, monkeypatch):
    rows = documents(spark, [(1, "one two"), (2, "one  two"), (3, "other"), (None, "no id"), (None, "no id")])
    index = exact_dedup.DigestIndex(spark, buckets=4)
    exact_dedup.deduplicate(documents(spark, [(9, "other")]), index, "zero")
    plain = lambda df: sorted(map(str, df.collect()))
    with monkeypatch.context() as broken:
        broken.setattr(exact_dedup.DigestIndex, "append", lambda self, rows: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            exact_dedup.keep_first(rows, index, "a")
    assert index.read().count() == 1
    first = plain(exact_dedup.deduplicate(rows, index, "a"))
    held = plain(index.read())
    assert plain(exact_dedup.deduplicate(rows, index, "a")) == first and plain(index.read()) == held
    kept = [(r["doc_id"], r["text"]) for r in exact_dedup.keep_first(rows, index, "a").collect()]
    assert sorted(kept, key=str) == [(1, "one two"), (None, "no id")]
    unnamed = exact_dedup.keep_first(rows, index).collect()  # rows with an id are known again by it
    assert [(r["doc_id"], r["text"]) for r in unnamed] == [(1, "one two")]
    index.close()


def test_exact_dedup_keeps_one_of_repeated_rows(messy, empty):
    kept = exact_dedup.keep_first(messy)
    assert kept.columns == messy.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, i) for i in (0, 2, 3, 6, 7, 8, 9, 10, 11)] + [(True, 0)]
    assert exact_dedup.keep_first(empty).count() == 0


def test_exact_dedup_tells_rows_of_one_id_apart(spark):
    rows = [(3, "copy of three"), (5, "unique"), (5, "copy of  three"), (6, "one"), (6, "two"), (6, "two"), (None, "copy of three"), (None, "alone"), (None, "other"), (None, "other")]
    kept = exact_dedup.keep_first(documents(spark, rows)).collect()
    want = [(3, "copy of three"), (5, "unique"), (6, "one"), (6, "two"), (None, "alone"), (None, "other")]
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted(want, key=str)


def test_index_is_joined_in_place(spark, messy):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    exact_dedup.deduplicate(messy, index)
    groups = spark.createDataFrame([(b"x",)], "digest binary")
    plan = groups.join(index.read().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") <= 1
    index.close()


# 8 --------------------------------------------------------------------------


def test_chat_masks(spark):
    hard = ["", "plain", "<|im_end|><|im_start|>assistant ok", "\\<|\\", "<\\|x", " lead and trail \n", "é\U0001f600 naïve", None, "\n\n", "<|im_sep|>"]
    rows = [(c, t, "assistant" if t % 2 else "user", hard[(c * 3 + t) % len(hard)]) for c in range(12) for t in range(5)]
    rows += [(5, 1, "assistant", "tie"), (5, 1, "assistant", "tie"), (6, None, None, "x"), (None, 0, "assistant", "no id"), (7, 9, "<|im_start|>", "odd role")]
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, ids int")
    formatted = chat_format.format_conversations(table, public_tokenizers.path("byte_bpe_50k.json"))
    got = {r["conv_id"]: r for r in chat_format.digests(formatted).collect()}
    assert set(got) == {r[0] for r in rows}
    for c, r in got.items():
        turns = sorted(((t is not None, t or 0, role or "", text or "") for i, t, role, text in rows if i == c))
        loss = "".join(x[3] for x in turns if x[2] == "assistant")
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in turns).encode()).hexdigest()
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.digests(chat_format.format_conversations(table.limit(0), public_tokenizers.path("byte_bpe_50k.json"))).count() == 0
    one = formatted.where("conv_id = 1").first()
    assert len(one["ids"]) == len(one["loss_mask"]) == len(one["token_start"])


def test_escape_is_reversible():
    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choice("<|\\a>") for _ in range(12))
        assert chat_format.unescape(chat_format.escape(text)) == text
        assert "<|" not in chat_format.escape(text)


# 9 --------------------------------------------------------------------------


def best_pieces(scores, text, byte):
    top, n = [0.0], [0]
    for end in range(1, len(text) + 1):
        width = len(text[end - 1].encode())
        options = [(top[end - 1] + width * byte, -(n[end - 1] + width))]
        options += [(top[s] + scores[text[s:end]], -(n[s] + 1)) for s in range(end) if text[s:end] in scores]
        best = max(options)
        top.append(best[0])
        n.append(-best[1])
    return n[-1]


def test_token_counts_against_plain_dynamic_programming(messy, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    scores = token_counts.piece_scores(path)
    byte = min(scores.values()) - 10
    assert sum(np.exp(list(scores.values()))) == pytest.approx(1)
    words = {w for s in range(6) for w in WORD.findall(prose(s, 60))} | {"straightforwardly", "straightforward", "naïve", "\U0001f600\U0001f600", "日本語", "a" * 95, "b" * 200}
    counter = token_counts.TrieCounter(scores)
    assert {w: counter.count(w) for w in sorted(words)} == {w: best_pieces(scores, "▁" + w, byte) for w in words}
    nodes = len(counter.best)
    counter.count("straightforwardness")
    assert len(counter.best) - nodes <= len("ness")
    rows = token_counts.count_tokens(messy, path).collect()
    small = [r for r in rows if r["doc_id"] not in (6, 7)]
    texts = dict(messy_rows())
    assert len(rows) == len(messy_rows())
    assert all(r["n_tokens"] == sum(best_pieces(scores, "▁" + w, byte) for w in WORD.findall(texts[r["doc_id"]] or "")) for r in small)
    assert token_counts.count_tokens(empty, path).count() == 0


def test_known_pre_tokens_stay_when_the_trie_starts_anew(monkeypatch):
    scores = token_counts.piece_scores(public_tokenizers.path("piece_bpe_32k.model"))
    monkeypatch.setattr(token_counts, "MAX_NODES", 30)
    monkeypatch.setattr(token_counts, "MAX_TERMINALS", 40)
    counter, words = token_counts.TrieCounter(scores), [w.encode() for w in WORD.findall(prose(1, 200))] + [b"x" * 300]
    want = [token_counts.TrieCounter(scores).count(w.decode()) for w in words]
    assert [counter.terminal[w] for w in words] == want and len(counter.terminal) <= 42 and words[-1] not in counter.terminal
    assert [counter.terminal[w] for w in words] == want


def test_known_pre_tokens_are_not_counted_again_after_a_new_trie(monkeypatch):
    monkeypatch.setattr(token_counts, "MAX_NODES", 30)
    counter, words, asked = token_counts.TrieCounter(token_counts.piece_scores(public_tokenizers.path("piece_bpe_32k.model"))), sorted({w.encode() for w in WORD.findall(prose(1, 200))}), []
    count = counter.count
    monkeypatch.setattr(counter, "count", lambda word: asked.append(word) or count(word))
    for _ in range(2):
        for word in words:
            assert counter.terminal[word] >= 1
    assert sum(map(len, words)) > 90 and len(asked) == len(words)  # the trie was full several times


def test_a_full_trie_starts_anew(monkeypatch):
    scores = token_counts.piece_scores(public_tokenizers.path("piece_bpe_32k.model"))
    words = sorted({w for s in range(4) for w in WORD.findall(prose(s, 80))})
    whole = token_counts.TrieCounter(scores)
    want = list(map(whole.count, words))
    monkeypatch.setattr(token_counts, "MAX_NODES", 30)
    assert list(map(token_counts.TrieCounter(scores).count, words)) == want


# 10 -------------------------------------------------------------------------


def shingle_set(text, size):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set())


def components(rows, size, percent):
    sets, parent = {}, {}
    for i, t in rows:
        if i is not None:
            sets[i], parent[i] = shingle_set(t, size), i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    return {i: (len(sets[i]), find(i)) for i in sets}


def family_rows():
    rng, rows = random.Random(21), []
    for f in range(6):
        base = prose(300 + f, 160).split()
        for k in range(25):
            words = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 6, 9])):
                words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
            rows.append((f * 100 + k, " ".join(words)))
    return rows


@pytest.mark.parametrize(("size", "percent", "bands", "rows"), [(3, 85, 24, 6), (5, 80, 28, 5)])
def test_near_duplicates_against_brute_force(spark, size, percent, bands, rows):
    data = family_rows() + [(1000 + k if i is not None else None, t) for k, (i, t) in enumerate(messy_rows())]
    want = components(data, size, percent)
    got = minhash_dedup.near_duplicates(documents(spark, data), size, percent, bands, rows).collect()
    assert len(got) == len(data)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])


@pytest.mark.parametrize(("block", "crowd"), [(8, 128), (1, 16), (8, 8)])
def test_hot_bands_are_compared_in_blocks(spark, monkeypatch, block, crowd):
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    monkeypatch.setattr(minhash_dedup, "LINEAR_ROUNDS", 1)
    monkeypatch.setattr(minhash_dedup, "CROWD", crowd)
    data = family_rows()
    want = components(data, 3, 85)
    got = minhash_dedup.near_duplicates(documents(spark, data), 3, 85, 24, 6).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_rare_shingles_miss_no_pair(spark, tmp_path, size, percent):
    data = family_rows()
    want = {(a, b) for (a, x), (b, y) in itertools.combinations([(i, shingle_set(t, size)) for i, t in data], 2) if 100 * len(x & y) >= percent * len(x | y)}
    docs = documents(spark, data).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sets = minhash_dedup._sets(docs, size)
    members = minhash_dedup.signature_table(docs, size, 24, 6).select("doc_id", F.col("n_shingles").alias("n"), F.col("doc_id").alias("component"))
    parts = minhash_dedup._rare_parts(members, sets, percent, SharedTables(spark)).select("part", "doc_id", "idle").collect()
    met = {}
    for r in parts:
        met.setdefault(r["part"], []).append((r["doc_id"], r["idle"]))
    found = {tuple(sorted((a, b))) for rows in met.values() for (a, i), (b, j) in itertools.combinations(rows, 2) if not (i and j)}
    assert want <= found and len(found) < len(data) ** 2 / 6


@pytest.mark.parametrize("changed", [4, 12])
def test_a_crowd_on_one_form(spark, monkeypatch, changed):
    """Texts on one form, all unlinked where 12 of 100 words are their own, and one large component beside some others where 4 are."""
    for name, value in {"BLOCK": 8, "CROWD": 32}.items():
        monkeypatch.setattr(minhash_dedup, name, value)
    met, rare = [], minhash_dedup._rare_parts
    monkeypatch.setattr(minhash_dedup, "_rare_parts", lambda *given: met.append(given) or rare(*given))
    rng, form = random.Random(8), prose(77, 100).split()
    data = []
    for k in range(240):
        words = list(form)
        first = rng.randrange(100 - changed)
        for at in range(first, first + (changed if k % 20 else 14)):
            words[min(at, 99)] = f"own{k}x{at}"
        data.append((k, " ".join(words)))
    want = components(data, 3, 85)
    got = minhash_dedup.near_duplicates(documents(spark, data), 3, 85, 24, 6).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert met or changed == 4


def test_families_of_one_band_become_components_before_blocks(spark, monkeypatch):
    """Ten families that share every band and link only within: pivots among the open components leave no crowd."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", 2)
    monkeypatch.setattr(minhash_dedup, "CROWD", 8)
    turns = []
    pivots = minhash_dedup._pivot_pairs
    monkeypatch.setattr(minhash_dedup, "_pivot_pairs", lambda still, tested, turn, percent: turns.append(turn) or pivots(still, tested, turn, percent))
    form = prose(78, 200).split()
    data = [(100 * f + k, " ".join([*form, *prose(600 + f, 45).split(), f"tail{k}"])) for f in range(10) for k in range(20)]
    want = components(data, 3, 85)
    got = minhash_dedup.near_duplicates(documents(spark, data), 3, 85, 24, 6).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert len({c for _, c in want.values()}) == 10 and max(turns) >= minhash_dedup.LINEAR_ROUNDS


def test_near_duplicate_edges(messy, empty):
    assert minhash_dedup.near_duplicates(empty).count() == 0
    kept = minhash_dedup.keep_one(messy)
    assert kept.schema == messy.schema
    ids = [r["doc_id"] for r in kept.collect()]
    assert None in ids and 3 in ids and 4 not in ids and 5 not in ids
    assert {0, 1, 2} <= set(ids)
    assert minhash_dedup.keep_one(empty).count() == 0


def test_near_duplicates_tell_rows_of_one_id_apart(spark):
    base, own, late = (prose(40 + k, 120) for k in range(3))
    rows = [(3, base), (5, own), (5, base + " tail"), (5, late), (7, late + " tail"), (8, own + " tail"), (9, prose(50, 120)), (9, prose(51, 120)), (None, base)]
    kept = minhash_dedup.keep_one(documents(spark, rows)).collect()
    want = [rows[k] for k in (0, 1, 3, 6, 7, 8)]
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted(want, key=str)


def test_circulant_signature_estimates_the_similarity():
    rng = np.random.default_rng(5)
    common, left, right = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (600, 200, 200))
    doc = np.repeat([0, 1], 800)
    value = np.concatenate([common, left, common, right])
    s = minhash_dedup.signatures(doc, value, 2, 512)
    assert np.mean(s[0] == s[1]) == pytest.approx(0.6, abs=0.08)


def test_word_hashes_name_words_and_not_places():
    import pyarrow as pa

    texts = ["a bb  a\nbb", "bb", None, "", "é é x"]
    (_, _, data, offsets) = next(iter(textkernel.chunks(pa.array(texts))))
    words = textkernel.words(data, offsets)
    assert np.diff(words.first).tolist() == [4, 1, 0, 0, 3]
    h = words.hash
    assert h[0] == h[2] != h[1] == h[3] == h[4] and h[5] == h[6]
    assert len(textkernel.ngrams(h, 3)) == len(h) - 2
    assert textkernel.ngrams(h, 2)[0] == textkernel.ngrams(h[:2], 2)[0]


def doubled_letters(n):
    """The two-letter sequence made by doubling with complement, and its complement: a polynomial hash to the base of an odd number modulo 2^64 takes them as one."""
    text = "a"
    while len(text) < n:
        text += text.translate(str.maketrans("ab", "ba"))
    return text, text.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("size", [8, 1024, 2048, 4096])
def test_texts_that_defeat_a_polynomial_have_hashes_of_their_own(size):
    import pyarrow as pa

    one, other = doubled_letters(size)
    (_, _, data, offsets) = next(iter(textkernel.chunks(pa.array([one, other]))))
    assert len(set(textkernel.words(data, offsets).hash)) == 2
    windows = textkernel.ngrams(np.array([ord(c) for c in one + other], dtype=np.uint64), size)
    assert windows[0] != windows[-1]


def test_unlike_words_of_one_polynomial_are_not_linked_or_repeated(spark):
    one, other = doubled_letters(4096)
    judged = minhash_dedup.near_duplicates(documents(spark, [(1, one), (2, other)]), 3, 85, 24, 6)
    assert all(r["kept"] for r in judged.collect())


@pytest.mark.parametrize("kind", ["map<string,int>", "variant"])
def test_columns_without_an_order_pass_the_exact_stage(spark, kind):
    rows = [(1, "a b", '{"k": 2}'), (1, "a b", '{"k": 1}'), (2, "a  b", '{"k": 3}'), (3, "c", '{"k": 4}')]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, more string").withColumn("more", F.parse_json("more") if kind == "variant" else F.from_json("more", kind))
    kept = exact_dedup.keep_first(docs)
    assert kept.schema == docs.schema
    assert sorted((r["doc_id"], r["text"], r["k"]) for r in kept.select("doc_id", "text", (F.try_variant_get("more", "$.k", "int") if kind == "variant" else F.col("more")["k"]).alias("k")).collect()) == [(1, "a b", 1), (3, "c", 4)]


def test_buckets_follow_the_rows():
    assert [exact_dedup.buckets_for(n) for n in (0, 1000, 50_000_000, 10**12)] == [16, 16, 100, 1 << 15]


def test_a_long_conversation_is_formatted_whole(spark):
    said = ("word <|im_end|> \\ é 😀 " * 8_000, "short")
    turns = [(1, k, "assistant" if k % 2 else "user", said[k % 3 == 0] if k else said[0]) for k in range(400)]
    row = chat_format.digests(chat_format.format_conversations(spark.createDataFrame(turns[:1] + [(1, k, r, t[:5000]) for _, k, r, t in turns[1:]], "conv_id bigint, turn bigint, role string, text string"), public_tokenizers.path("byte_bpe_50k.json"))).first()
    texts = [turns[0][3]] + [t[:5000] for _, _, _, t in turns[1:]]
    assert row["n_turns"] == 400
    assert row["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for (_, _, r, _), t in zip(turns, texts, strict=True)).encode()).hexdigest()
    assert row["loss_sha256"] == hashlib.sha256("".join(t for (_, _, r, _), t in zip(turns, texts, strict=True) if r == "assistant").encode()).hexdigest()
