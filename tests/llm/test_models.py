"""Learned operators by held-out accuracy, and how they treat odd rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import bpe, language, ngram_join, packing, passages, quality, suffixes
from plumbline.llm.common import table
from tests.llm.test_exact import documents, prose

SF = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 100
    assert np.mean([r.lang == r.lang_pred for r in rows]) >= 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_depends_on_text_alone(spark):
    docs = table(spark, SF, "documents")
    twisted = docs.withColumn("source", F.lit("x")).withColumn("lang", F.when(language.held_out(F.col("doc_id")), F.lit("fr")).otherwise(F.col("lang")))
    a = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs).collect()}
    b = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(twisted).collect()}
    assert a == b


def test_language_odd_rows(spark):
    rows = [(i, prose(i, 40)) for i in range(10)] + [(20, None), (21, ""), (22, "1234 !!"), (24, "² Ⅷ _"), (None, "words"), (0, prose(0, 40)), (23, "x" * 100_000)]
    got = language.identify(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (20, 21, 22, 24))
    assert by[1].lang_pred == "en"
    assert language.identify(documents(spark, rows).limit(0)).collect() == []
    unlabelled = documents(spark, rows).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(unlabelled).collect()} == {"und"}


def test_binding_tells_the_order_of_letters():
    space = language.Space()
    a, b = (space.bundle(*language.grams(t)) for t in ("abc", "cba"))
    assert abs(a @ b) < 0.3 * np.linalg.norm(a) * np.linalg.norm(b)


def test_language_profiles_letter_by_letter(spark):
    """Prototypes and cosines from the definition: rotate, multiply, add, letter by letter."""
    words = {"en": "the cat and the dog", "de": "der hund und die katze", "zh": "猫和狗 在 家里", "ru": "кошка и собака дома"}
    rows = [(i, f"{words[lang]} {words[lang].split()[i % 3]}", lang) for i, lang in enumerate(sorted(words) * 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)

    def profile(text):
        letters = [ord(c) if c != " " else 0 for c in f" {' '.join(text.lower().split())} "]
        total = np.zeros(language.WIDTH)
        for a, b, c in zip(letters, letters[1:], letters[2:], strict=False):
            x, y, z = (language.letter_vector(v).astype(float) for v in (a, b, c))
            total += np.roll(x, 2) * np.roll(y, 1) * z
        return total

    own = {lang: sum(profile(t) for i, t, x in rows if x == lang and not language.is_held_out(i)) for lang in words}
    unit = {k: v / np.linalg.norm(v) for k, v in own.items()}
    shared = np.mean(list(unit.values()), axis=0)
    unit = {k: (v - shared) / np.linalg.norm(v - shared) for k, v in unit.items()}
    assert {k: v.tolist() for k, v in language.prototypes(docs).items()} == {k: pytest.approx(v.tolist(), abs=1e-9) for k, v in unit.items()}
    for r in language.identify(docs).collect():
        v = profile(rows[r.doc_id][1])
        cosine = {k: float(u @ v / np.linalg.norm(v)) for k, u in unit.items()}
        assert r.lang_pred == max(cosine, key=cosine.get) == rows[r.doc_id][2]
        assert r.score == pytest.approx(1 / sum(np.exp(language.SHARPNESS * (c - cosine[r.lang_pred])) for c in cosine.values()))


def test_language_ties_go_to_the_name_that_sorts_first(spark):
    rows = [(2 * i + j, "same words for both", lang) for i in range(20) for j, lang in enumerate(("xx", "aa"))]
    got = language.identify(spark.createDataFrame([*rows, (99, "other letters", None)], "doc_id long, text string, lang string")).collect()
    assert {r.lang_pred for r in got} == {"aa"}


def test_letters_of_unlike_scripts_have_vectors_of_their_own():
    assert all(abs(int(language.letter_vector(a).astype(int) @ language.letter_vector(b))) < 200 for a, b in ((97, 97 + 511), (97, 98), (0x4E00, 0x4E00 + 511)))


def test_quality_weights_and_calibration_directly(spark):
    """Kernel ridge by one solve over all rows, and the calibration by brute-force isotonic means."""
    r = np.random.default_rng(3)
    rows = [(i, prose(i, 30 + i % 50) if i % 3 else "of " * (30 + i % 40) + prose(i, 10)) for i in range(150)]
    y = np.array([float((i % 3 > 0) != (r.random() < 0.1)) for i, _ in rows])
    labels = spark.createDataFrame([(i, int(v)) for (i, _), v in zip(rows, y, strict=True)], "doc_id long, quality int")
    model = quality.fit(quality.described(documents(spark, rows)), labels)
    fold = np.array([zlib.crc32(str(i).encode()) % 5 for i, _ in rows])
    x = np.array([quality.statistics(t) for _, t in rows])
    train = fold > 0
    assert model.mean == pytest.approx(x[train].mean(0)) and model.scale == pytest.approx(np.where(x[train].std(0) > 1e-9, x[train].std(0), 1))
    z = model.lift(x)
    for out in range(5):
        own = train & (fold != out)
        a = z[own].T @ z[own] + quality.RIDGE * max(1.0, own.sum()) * np.eye(z.shape[1]) / 10
        assert model.weights[:, out] == pytest.approx(np.linalg.solve(a, z[own].T @ y[own]), rel=1e-4, abs=1e-6)
    # The lift approximates a Gaussian kernel.
    s = np.clip((x - model.mean) / model.scale, -quality.CLIP, quality.CLIP)[:40]
    kernel = np.exp(-((s[:, None] - s[None]) ** 2).sum(-1) / (2 * x.shape[1]))
    assert np.abs(z[:40, :-1] @ z[:40, :-1].T - kernel).mean() < 0.06
    # Isotonic regression: the level at a place is the largest, over where a run begins, of the least mean, over where it ends.
    raw = np.array([z[i] @ model.weights[:, fold[i]] for i in np.flatnonzero(train)])
    at = np.rint((np.clip(raw, -0.5, 1.5) + 0.5) / 2 * quality.BINS).astype(int)
    bins = sorted(set(at.tolist()))
    hits, seen = (np.array([f[at == b].sum() for b in bins]) for f in (y[train], np.ones(len(raw))))
    want = [max(min(hits[j : k + 1].sum() / seen[j : k + 1].sum() for k in range(i, len(bins))) for j in range(i + 1)) for i in range(len(bins))]
    place = np.array(bins) / quality.BINS * 2 - 0.5
    got = np.array([model.levels[np.abs(model.levels - w).argmin()] for w in want])
    assert got == pytest.approx(np.array(want)) and (np.diff(model.levels) > -1e-12).all()
    assert np.interp(place[[0, -1]], model.knots, model.levels) == pytest.approx([want[0], want[-1]])


def test_quality_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.95
    good = [r for r in rows if r.quality == 1]
    assert np.mean([r.predicted for r in good]) >= 0.99
    assert all(r.predicted == (1 if r.score >= 0.3 else 0) for r in rows)


def test_quality_ignores_held_out_labels_and_other_columns(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    wrong = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    b = {r.doc_id: r.score for r in quality.classify(docs.withColumn("lang", F.lit("zz")), wrong).collect()}
    assert a == pytest.approx(b, abs=1e-6)


def test_quality_odd_rows(spark):
    rows = [(i, prose(i, 50)) for i in range(20)] + [(i, "of " * 90) for i in range(20, 40)] + [(50, None), (51, ""), (52, "y" * 50_000), (None, "text"), (0, prose(0, 50))]
    labels = spark.createDataFrame([(i, int(i < 20), "q") for i in range(40)] + [(1, 1, "q"), (2, None, "q"), (None, 1, "q"), (3, 7, "q")], "doc_id long, quality int, x string")
    got = quality.classify(documents(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[5].predicted == 1 and by[25].predicted == 0 and by[None].held_out
    assert {r.score for r in quality.classify(documents(spark, rows), labels.limit(0)).collect()} == {0.5}
    assert quality.classify(documents(spark, rows).limit(0), labels).collect() == []
    kept = quality.kept(documents(spark, rows), labels)
    assert kept.columns == documents(spark, rows).columns
    assert {5, None} <= {r.doc_id for r in kept.collect()} and 25 not in {r.doc_id for r in kept.collect()}


def test_isotonic_is_the_closest_monotone_fit():
    r = np.random.default_rng(0)
    y, w = r.random(40), r.random(40) + 0.1
    knots, levels = quality.isotonic(np.arange(40.0), y, w)
    assert (np.diff(levels) >= 0).all() and (np.diff(knots) > 0).all()
    assert (levels * np.array([w[a:b].sum() for a, b in _blocks(y, w, levels)])).sum() == pytest.approx((y * w).sum())


def _blocks(y, w, levels):
    at, out = 0, []
    for level in levels:
        end = at + 1
        while abs(np.average(y[at:end], weights=w[at:end]) - level) > 1e-12:
            end += 1
        out.append((at, end))
        at = end
    return out


def test_empty_tables(spark):
    import public_tokenizers

    none = documents(spark, [(1, "x")]).limit(0)
    assert ngram_join.near_duplicates(none).collect() == []
    assert suffixes.without_repeats(none).collect() == []
    assert bpe.round_trip(none, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).collect() == []
    assert packing.packed(none, public_tokenizers.path("word_bpe_49k.json")).collect() == []
    assert passages.without_passages(none).collect() == []


def test_pipeline_stages_on_their_own_input(spark):
    """Each stage against brute force on what its predecessor kept."""
    from collections import Counter

    import corpus_pipeline as p
    from tests.llm.test_exact import brute_components, brute_lines

    docs, kept = table(spark, "/root/testdata/sf0.001", "documents").select(*p.COLUMNS), {}
    kept["in"] = docs.collect()
    for name, stage in p.STAGES:
        out = p.written(stage(spark, docs, "/root/testdata/sf0.001"), "test")
        kept[name] = out.collect()
        if name != p.STAGES[-1][0]:
            assert out.columns == p.COLUMNS
            assert all(r.n_chars == len(r.text) for r in kept[name])
        docs = out
    labels = {r.doc_id: r.quality for r in table(spark, "/root/testdata/sf0.001", "labels").collect()}
    first = {r.doc_id for r in kept["quality classifier"]}
    assert all(i in first for i, q in labels.items() if q == 1)
    assert np.mean([i not in first for i, q in labels.items() if q == 0]) >= 0.8
    lines_out = {r.doc_id: r.text for r in kept["line dedup"]}
    assert {i: t for i, t, _ in brute_lines([(r.doc_id, r.text, r.source) for r in kept["quality classifier"]])} == lines_out
    want = {i for i, _, c in brute_components([(r.doc_id, r.text) for r in kept["line dedup"]]) if i == c}
    assert {r.doc_id for r in kept["n-gram Jaccard join"]} == want
    shorter = {r.doc_id: r.text for r in kept["substring dedup"]}
    seen = Counter()
    for r in kept["n-gram Jaccard join"]:
        w = shorter[r.doc_id].lower().split()
        assert len(w) <= len(r.text.split())
        seen.update({tuple(w[i : i + 60]) for i in range(len(w) - 59)})
    runs = [k for k, n in seen.items() if n > 1 and len(set(k)) > 20]
    assert not runs
    assert {r.doc_id for r in kept["best-fit packing"]} == set(shorter)


def test_unknown_words_do_not_matter():
    r = random.Random(1)
    x = " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 12))) for _ in range(2_000))
    assert len(quality.statistics(x)) == len(quality.NAMES) == len(quality.statistics(""))
