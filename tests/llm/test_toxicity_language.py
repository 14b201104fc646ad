import random
import re
import zlib

import numpy as np
import pyarrow as pa

from foldcast.llm import language, toxicity


def text(rng, bad=()):
    words = ["".join(rng.choice("abcdeghiklmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(5, 60))]
    for b in bad:
        words.insert(rng.randrange(len(words)), b)
    return " ".join(words)


def test_machine_learns_pairs_and_holds_out(spark, tmp_path):
    """Toxic only if an insult meets a group: additive weights can't part these, the pair term does."""
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(1600):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        rows.append((i, text(rng, ["Vermin!"] * insult + ["zorgons,"] * group), "en", "s", 0.5))
        labels.append((i, 1, int(insult and group)))
    rows += [(9001, None, "en", "s", 0.1), (9002, "", "en", "s", 0.1), (None, "vermin zorgons", "en", "s", 0.1), (9003, "vermin zorgons " * 20000, "en", "s", 0.1), (9003, "vermin zorgons " * 20000, "en", "s", 0.1)]
    labels += [(9001, 1, 0), (None, 1, 1), (9002, 1, None), (3, 0, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = toxicity.op5(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    truth = {d: y for d, _, y in labels[:1600]}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert 300 < len(held) < 500
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.predicted == 1 for r in got if r.doc_id in (None, 9003))
    assert all(r.predicted == 0 for r in got if r.doc_id in (9001, 9002))


def learned(spark, rows, test):
    """Predictions for ``test`` of a machine that is fitted to (text, label) rows, none of them held out."""
    ids = [i for i in range(5 * len(rows)) if zlib.crc32(str(i).encode()) % 4 != 2][: len(rows)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in zip(ids, rows)], "doc_id long, text string")
    machine = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, (_, y) in zip(ids, rows)], "doc_id long, toxic int"))
    return machine, machine.scores(pa.array([t for t, _ in test]))


def test_machine_learns_what_no_term_tells_alone(spark):
    """Toxic if just one of two words is there: each of them tells nothing by itself."""
    rng, rows = random.Random(4), []
    for _ in range(2500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append((text(rng, ["blorp"] * a + ["quaxy"] * b), int(a != b)))
    machine, scores = learned(spark, rows[:2000], rows[2000:])
    assert ((scores >= 0.5) == np.array([y for _, y in rows[2000:]])).mean() > 0.97
    assert len(machine.buckets) < 20


def test_machine_learns_rare_insults(spark):
    """Ten insults in one of forty toxic texts each."""
    rng, rows = random.Random(7), []
    insults = ["grub", "skaz", "plonker", "wretchling", "drongo", "muckface", "zitbag", "toadlet", "nitwitty", "oafish"]
    for i in range(2600):
        bad = i % 4 == 0
        rows.append((text(rng, [rng.choice(insults)] * bad), int(bad)))
    _, scores = learned(spark, rows[:2000], rows[2000:])
    truth = np.array([y for _, y in rows[2000:]])
    assert (scores[truth == 1] >= 0.3).mean() > 0.95 and (scores[truth == 0] >= 0.3).mean() < 0.02


def test_shuffled_labels_teach_nothing(spark):
    rng = random.Random(8)
    rows = [(text(rng), rng.randint(0, 1)) for _ in range(800)]
    machine, scores = learned(spark, rows, rows)
    assert len(machine.buckets) <= 3 and abs(scores.mean() - 0.5) < 0.1


def test_scores_equal_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    words = ["trash", "trashy", "é1", "no", "somewhat", "zz"]
    texts = ["Trash trashy, TRASHY", None, "", "é1 trash no", "somewhat zz  zz unknown", "no no"]
    every = np.unique(np.concatenate([b for _, b in [toxicity.buckets(pa.array([w])) for w in words]]))
    machine = toxicity.Machine(every, -0.3, rng.normal(0, 1, len(every)), rng.normal(0, 1, (len(every), toxicity.FACTORS)))
    for t, got in zip(texts, machine.scores(pa.array(texts))):
        parts = {p.encode()[:n] for p in re.findall(r"\w+", (t or "").lower()) for n in (99, 4, 5, 6) if n == 99 or len(p.encode()) > n}
        here = {int(next(toxicity.terms(pa.array([p.decode()])))[1][0] >> np.uint64(64 - toxicity.BITS)) for p in parts}  # a part as a word of its own
        at = [int(np.flatnonzero(every == b)[0]) for b in sorted(here) if b in every]
        z = machine.bias + sum(machine.weights[i] for i in at) + sum(machine.factors[i] @ machine.factors[j] for i in at for j in at if i < j)
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-9


def test_terms_are_found_whatever_the_slice():
    texts = pa.array(["Trash trashy, TRASHY", None, "", "é trash"])
    words = {h for row, hs in toxicity.terms(texts) for r, h in zip(row, hs) if r == 0}
    assert len(words) == 3  # tras, trash (a word and a prefix) and trashy
    rows = np.concatenate([row for row, _ in toxicity.terms(texts)])
    assert set(rows.tolist()) == {0, 3}


def test_no_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    machine = toxicity.fit(docs, none)
    assert toxicity.score(docs, machine).first().predicted == 0
    assert toxicity.score(docs.limit(0), machine).count() == 0
    assert toxicity.score(docs, machine).columns == ["doc_id", "text", "score", "predicted"]


EN = "the of and to in that was for with he is on as by at from this have are not they which her be".split()
DE = "der die und das nicht ein ist zu von den mit sich auf für eine auch dem werden aus bei nach schön über".split()
RU = "и в не на что он с как это но она они мы все так его только мне было вот".split()


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def test_languages_spans_and_held_out(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, prose(rng, w, rng.randint(3, 80)), l) for i, (l, w) in enumerate([("en", EN), ("de", DE), ("ru", RU)] * 200)]
    odd = [(9000, None, "en"), (9001, "", "en"), (9002, "12 34 .,", "de"), (9003, prose(rng, DE, 3000), None), (None, prose(rng, RU, 30), None), (9004, "漢字かな", None), (9004, "漢字かな", None)]
    spark.createDataFrame([(*r, "s") for r in rows + odd], "doc_id long, text string, lang string, score string").write.parquet(str(tmp_path / "documents.parquet"))
    got = language.op10(spark, str(tmp_path)).collect()
    truth = {d: l for d, _, l in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.98
    found = {r.doc_id: r.lang_pred for r in got}
    assert [found[d] for d in (9000, 9001, 9002, 9003, None)] == ["und", "und", "und", "de", "ru"]
    assert all(0 <= r.score <= 1 for r in got) and len(got) == len(rows) + len(odd)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    mixed = spark.createDataFrame([(1, prose(rng, EN, 40) + " " + prose(rng, DE, 60) + " " + prose(rng, RU, 9))], "doc_id long, text string")
    spans = language.identify(mixed, language.fit(docs), spans=True).first().spans
    assert [s.lang for s in spans] == ["en", "de", "ru"]
    assert abs(spans[1].first - 40) <= 3 and spans[2].first == 100
    assert language.identify(docs.limit(0), language.fit(docs.limit(0))).count() == 0


def test_path_equals_plain_viterbi():
    rng = np.random.default_rng(5)
    model = language.Model(["a", "b", "c"], rng.normal(-5, 2, (3, language.GRAMS)).astype(np.float32), np.ones((3, len(language.SCRIPTS)), bool))
    texts = [" ".join("".join(rng.choice(list("abcdef")) for _ in range(rng.integers(1, 4))) for _ in range(n)) for n in (0, 1, 2, 5, 9, 9)]
    text = language._Text(pa.array(texts))
    scores, path = model.words(text), model.path(text)
    for i in range(len(texts)):
        mine = np.flatnonzero(text.row == i)
        if not len(mine):
            continue
        value = lambda p: sum(scores[w, s] for w, s in zip(mine, p)) - language.PENALTY * sum(a != b for a, b in zip(p, p[1:]))
        best = max(value(p) for p in np.ndindex(*[3] * len(mine)))
        assert abs(value(path[mine]) - best) < 1e-6


def plain_gram(points, size):
    """The number of a gram, given from its last byte backwards; 0x100 is the edge of a word."""
    h = 0
    for b in points[:size]:
        h = (h * 0x01000193 + b + size) & 0xFFFFFFFF
    h ^= h >> 15
    return ((h * 0x2C1B3C6D & 0xFFFFFFFF) >> 16) & (language.GRAMS - 1)


def plain_words(t):
    """(letters, script, gram numbers) of each word of a text."""
    import regex

    out = []
    for w in regex.findall(r"\p{L}+", t or ""):
        point = ord(w[len(w) // 2])
        script = [s for first, s in language.RANGES if first <= point][-1]
        marked = [0x100, 0x100, 0x100, *(b + 32 if 65 <= b <= 90 else b for b in w.encode()), 0x100]
        out.append((len(w), script, [plain_gram(marked[i::-1], size) for i in range(3, len(marked)) for size in language.SIZES]))
    return out


def test_languages_equal_a_plain_version(spark):
    """Gram counts, script gate, paths and scores of the whole query, row by row."""
    rng = random.Random(12)
    bank = {"en": EN, "de": DE, "ru": RU}
    rows = [(i, " ".join(prose(rng, bank[rng.choice("en de ru".split())], rng.randint(1, 9)) for _ in range(rng.randint(1, 4))) + rng.choice(["", " 漢字", " 12!", " Été"]), rng.choice(["en", "de", "ru", None])) for i in range(160)]
    rows += [(400, None, "en"), (401, "", "de"), (402, "...", None)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double").repartition(3)
    names = ["de", "en", "ru"]
    counts, letters = {l: np.full(language.GRAMS, language.SMOOTHING) for l in names}, {l: np.zeros(len(language.SCRIPTS)) for l in names}
    for d, t, l in rows:
        if l and t and zlib.crc32(str(d).encode()) % 4 != 2:
            for n, script, grams in plain_words(t):
                letters[l][script] += n
                np.add.at(counts[l], grams, 1)
    logs = {l: np.log(counts[l] / counts[l].sum()) for l in names}
    got = {r.doc_id: r for r in language.identify(docs, language.fit(docs)).collect()}
    for d, t, _ in rows:
        words = plain_words(t)
        if not words:
            assert (got[d].lang_pred, got[d].score) == ("und", 0.0)
            continue
        paths = {l: (0.0, []) for l in names}
        for n, script, grams in words:
            fits = [l for l in names if script == 0 or letters[l][script] > language.LEAST_SHARE * letters[l].sum()] or names
            value = {l: logs[l][grams].sum() + (0 if l in fits else language.OUT * n) for l in names}
            paths = {l: max(((v - language.PENALTY * bool(p and p[-1] != l) + value[l], [*p, l]) for v, p in paths.values()), key=lambda x: x[0]) for l in names}
        path = max(paths.values(), key=lambda x: x[0])[1]
        share = {l: sum(w[0] for w, p in zip(words, path) if p == l) / sum(w[0] for w in words) for l in names}
        assert abs(share[got[d].lang_pred] - max(share.values())) < 1e-9 and abs(got[d].score - max(share.values())) < 1e-9


def test_junk_labels_do_not_grow_the_model(spark, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES", 2)
    rng = random.Random(1)
    rows = [(i, prose(rng, EN if i % 2 else DE, 20), "en" if i % 2 else "de") for i in range(80)] + [(100 + i, "zzz", f"junk{i}") for i in range(50)]
    assert language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")).languages == ["de", "en"]
