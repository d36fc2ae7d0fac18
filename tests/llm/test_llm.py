"""Operators for language-model data on small cases and against brute force."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.llm.language import LanguageModel, fit_languages, label_languages, language_code, prose_blocks
from barloom.llm.leaks import ItemIndex, leaked_items, plain_words
from barloom.llm.nearest import NearestBuffer, nearest_join, nearest_replay, nearest_stream
from barloom.llm.packing import pack, pack_documents
from barloom.llm.topn import ROW_GROUPS, planned, top_n, with_floors

MINUTE = 60_000_000


# --- top N


def test_top_n_with_ties_nulls_and_repeats(spark):
    rows = [("g", "b", 5.0, "x"), ("g", "a", 5.0, "x"), ("g", "B", 5.0, "x"), ("g", "c", 9.0, "x"), ("g", "d", None, "x"), ("g", "e", float("nan"), "x"), ("g", None, 9.0, "x"), (None, "q", 1.0, "x"), ("h", "z", -1.0, "x"), ("h", "z", -1.0, "x"), ("h", "é", -1.0, "x")]
    df = spark.createDataFrame(rows, "g string, item string, s double, rank_no string")
    got = [(r.g, r.rank_no, r.item) for r in top_n(df, ["g"], "s", "item", 3).orderBy("g", "rank_no").collect()]
    assert got == [("g", 1, "c"), ("g", 2, "B"), ("g", 3, "a"), ("h", 1, "z"), ("h", 2, "z"), ("h", 3, "é")]
    assert top_n(df.where("false"), ["g"], "s", "item", 3).count() == 0


def test_top_n_skips_row_groups_and_keeps_the_result(spark):
    rng = random.Random(3)
    rows = [("hot", f"i{i:06d}", float(rng.randrange(5000))) for i in range(60_000)] + [(f"g{i % 50}", f"i{i:06d}", float(rng.randrange(50))) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, item string, s double").repartition(3)
    want = {}
    for g, i, s in rows:
        want.setdefault(g, []).append((-s, i))
    want = {(g, k + 1, i) for g, xs in want.items() for k, (_, i) in enumerate(sorted(xs)[:10])}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small as they are, several files
    plan = planned(df, ["g"], "s", "item", 10, 8_000).toPandas()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    skipped = plan[plan["top"] < plan["floor"]]
    # Most of the hot group lies in files and row groups that are never opened, and none of what is wanted does.
    assert plan["path"].nunique() > 1 and len(skipped) > 0.7 * len(plan) and (skipped["low"] == skipped["high"]).all()
    assert skipped["top"].max() <= min(-x for x, _ in sorted((-s, i) for g, i, s in rows if g == "hot")[:10])
    assert {(r.g, r.rank_no, r.item) for r in top_n(df, ["g"], "s", "item", 10, 8_000).collect()} == want
    assert {(r.g, r.rank_no, r.item) for r in top_n(df, ["g"], "s", "item", 10).collect()} == want


def test_floors_need_n_rows_of_one_group(spark):
    rows = [("a", 0, "x", "x", 5.0, 9.0, 6), ("a", 1, "x", "x", 4.0, 5.0, 4), ("b", 0, "x", "x", 1.0, 4.0, 9), ("b", 1, "x", "y", 0.0, 9.0, 50), ("c", 0, "z", "z", 1.0, 2.0, 9), ("c", 1, None, None, None, None, 3)]
    got = with_floors(spark.createDataFrame(rows, ROW_GROUPS), 10).collect()
    assert {(r.path, r.row_group): r.floor for r in got} == {("a", 0): 4.0, ("a", 1): 4.0, ("b", 0): 4.0, ("b", 1): None, ("c", 0): None, ("c", 1): None}


def test_groups_that_only_together_read_the_same(spark):
    df = spark.createDataFrame([("a\x1f1:b", "c", "i", 1.0), ("a", "b\x1f1:c", "j", 2.0)], "g string, h string, item string, s double")
    assert {(r.g, r.rank_no) for r in top_n(df, ["g", "h"], "s", "item", 1).collect()} == {("a\x1f1:b", 1), ("a", 1)}


# --- nearest time


def nearest_brute(left, right, tolerance):
    out = {}
    for k, i, t in left:
        c = sorted((abs(rt - t), rt, ri) for rk, ri, rt, v in right if rk == k and v is not None and abs(rt - t) <= tolerance)
        out[i] = c[0][2] if c else None
    return out


@given(st.integers(0, 10_000))
@settings(max_examples=60, deadline=None)
def test_buffer_against_brute_force(seed):
    rng = random.Random(seed)
    left = [("k", i, rng.randrange(200)) for i in range(20)]
    right = [("k", 100 + i, rng.randrange(200), rng.choice([None, 1.0, 2.0])) for i in range(20)]
    b, events, got = NearestBuffer(7), sorted([(t, 0, i, None) for _, i, t in left] + [(t, 1, i, v) for _, i, t, v in right], key=lambda x: x[:3]), {}
    for t, side, i, v in events:
        if side:
            b.add_right(np.array([t]), np.array([i]), np.array([np.nan if v is None else v]))
        else:
            b.add_left(np.array([t]), np.array([i]))
        ids, _, partner, _, _ = b.advance(t)
        got |= dict(zip(ids.tolist(), partner.tolist()))
        assert (b.right_t >= t - 2 * 7 - 1).all()
    ids, _, partner, _, _ = b.advance(None)
    got |= dict(zip(ids.tolist(), partner.tolist()))
    assert {i: (None if p < 0 else p) for i, p in got.items()} == nearest_brute(left, right, 7)


def frames(spark, left, right):
    at = lambda s: None if s is None else datetime(2024, 1, 1) + timedelta(seconds=s)
    lf = spark.createDataFrame([(k, i, at(t), "x") for k, i, t in left], "k string, lid long, lt timestamp, t string")
    rf = spark.createDataFrame([(k, i, at(t), v, "x") for k, i, t, v in right], "k string, rid long, rt timestamp, v double, id string")
    return lf, rf


@pytest.mark.parametrize("span", [400, 86_400])
def test_nearest_join_against_brute_force(spark, span):
    rng = random.Random(span)
    left = [(rng.choice("ab"), i, rng.randrange(5000)) for i in range(300)]
    right = [(rng.choice("abc"), 1000 + i, rng.randrange(5000), rng.choice([None, float("nan"), 0.5])) for i in range(200)]
    lf, rf = frames(spark, left + left[:50] + [(None, 900, 5), ("a", 901, None), ("a", None, 5)], right + [("a", 7, None, 1.0)])
    clean = [(k, i, t, None if v is None or v != v else v) for k, i, t, v in right]
    got = nearest_join(lf, rf, ["k"], "lid", "lt", "rid", "rt", "v", 60_000_000, keep_unmatched=True, span_us=span * 1_000_000).collect()
    assert len(got) == len(left)
    assert {r.left_id: r.right_id for r in got} == nearest_brute(left, clean, 60)
    assert all(r.value == 0.5 and abs(r.right_us - r.left_us) <= 60_000_000 for r in got if r.right_id is not None)
    only = nearest_join(lf, rf, ["k"], "lid", "lt", "rid", "rt", "v", 60_000_000, span_us=span * 1_000_000)
    assert only.count() == sum(r.right_id is not None for r in got)
    assert nearest_join(lf, rf.where("false"), ["k"], "lid", "lt", "rid", "rt", "v", 60_000_000).count() == 0
    assert nearest_join(lf.where("false"), rf, ["k"], "lid", "lt", "rid", "rt", "v", 60_000_000).count() == 0


def test_nearest_stream_gives_what_the_batch_gives(spark, tmp_path):
    rng = random.Random(5)
    left = [(rng.choice("ab"), i, 20 * i + rng.randrange(20)) for i in range(100)]
    right = [(rng.choice("ab"), 1000 + i, 20 * i + rng.randrange(20), 0.5) for i in range(100)]
    # Three batches in order of time, and a last one far behind that moves the watermark past all of them.
    late = [("a", 999, 100_000)]
    for n in range(3):
        lf, rf = frames(spark, left[34 * n:34 * (n + 1)], right[34 * n:34 * (n + 1)])
        lf.coalesce(1).write.mode("append").parquet(str(tmp_path / "l"))
        rf.coalesce(1).write.mode("append").parquet(str(tmp_path / "r"))
    lf, rf = frames(spark, late, [("a", 1999, 100_000, 0.5)])
    lf.coalesce(1).write.mode("append").parquet(str(tmp_path / "l"))
    rf.coalesce(1).write.mode("append").parquet(str(tmp_path / "r"))
    stream = lambda f, s: spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / f))
    joined = nearest_stream(stream("l", lf.schema), stream("r", rf.schema), ["k"], "lid", "lt", "rid", "rt", "v", 30_000_000, "3 hours")
    q = joined.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(180)
    got = {r.left_id: r.right_id for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = nearest_brute(left, right, 30)
    assert {i: got[i] for i in want if i in got} == {i: want[i] for i in want if i in got} and len(got) >= 100


def test_replay_in_slices_against_brute_force(spark):
    rng = random.Random(9)
    left = [(rng.choice("aab"), i, rng.randrange(9000)) for i in range(200)]
    right = [(rng.choice("abc"), 1000 + i, rng.randrange(9000), rng.choice([None, float("nan"), 0.5])) for i in range(150)]
    lf, rf = frames(spark, left + left[:30] + [(None, 900, 5), ("a", 901, None), ("a", None, 5)], right + [("a", 7, None, 1.0)])
    clean = [(k, i, t, None if v is None or v != v else v) for k, i, t, v in right]
    want = nearest_brute(left, clean, 60)
    for rows in (100, 1_000_000):
        got = nearest_replay(lf, rf, ["k"], "lid", "lt", "rid", "rt", "v", 60_000_000, keep_unmatched=True, slice_rows=rows, group_rows=rows).collect()
        assert len(got) == len(left) and {r.left_id: r.right_id for r in got} == want
        assert all(r.value == 0.5 for r in got if r.right_id is not None)
    only = nearest_replay(lf, rf, ["k"], "lid", "lt", "rid", "rt", "v", 60_000_000)
    assert {r.left_id: r.right_id for r in only.collect()} == {i: r for i, r in want.items() if r is not None}
    assert nearest_replay(lf.where("false"), rf.where("false"), ["k"], "lid", "lt", "rid", "rt", "v", 60_000_000).count() == 0


# --- packing


@given(st.lists(st.integers(0, 100), max_size=200))
@settings(max_examples=60, deadline=None)
def test_packing_places_every_item_once(sizes):
    groups = pack(np.array(sizes, np.int64), 100)
    assert sorted(i for g in groups for i in g) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in g) <= 100 for g in groups)


def test_packing_leaves_little_room():
    x = np.clip(np.exp(np.random.default_rng(0).normal(7, 0.55, 2000)), 150, 4096).astype(int)
    assert x.sum() / (len(pack(x, 4096)) * 4096) > 0.985


def test_one_id_repeated_is_many_groups(spark):
    df = spark.createDataFrame([(7, "word " * (k % 50)) for k in range(400)], "doc_id long, text string")
    got = pack_documents(df, capacity=256, group=40).collect()
    assert len(got) == 400 and len({r.window_id >> 32 for r in got}) > 5


def test_the_count_rises_no_further_than_needed():
    assert [sorted(len(g) for g in pack(np.array([60] * n), 100)) for n in (3, 7, 50)] == [[1] * 3, [1] * 7, [1] * 50]
    assert len(pack(np.array([40] * 7), 100)) == 4


def test_pack_documents(spark):
    rows = [(1, "alpha beta gamma", "w"), (2, None, "w"), (3, "", "w"), (4, "word " * 3000, "w"), (5, "x", None), (5, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, window_id string")
    got = pack_documents(df, capacity=256).collect()
    load = {}
    for r in got:
        load[r.window_id] = load.get(r.window_id, 0) + r.token_to - r.token_from
    assert max(load.values()) <= 256 and {r.doc_id for r in got} == {1, 2, 3, 4, 5}
    long = sorted((r.token_from, r.token_to) for r in got if r.doc_id == 4)
    assert long[0][0] == 0 and all(a[1] == b[0] for a, b in zip(long, long[1:])) and all(b - a == 256 for a, b in long[:-1])
    assert all(r.tokenizer == "byte_bpe_50k" for r in got) and sum(r.doc_id == 5 for r in got) == 2
    assert pack_documents(df.where("false")).count() == 0


# --- leaks

WORDS = "cooper barrel keeper hive slate lantern copper ring ferry toll bridge pear basket scale ounce weaver yarn dyed cellar mason stone chalk".split()


def leaks_brute(docs, items, n=12):
    grams = lambda t: {tuple(w[k:k + n]) for w in [plain_words(t).split()] for k in range(len(w) - n + 1)}
    return {(i, d) for i, it in items for d, dt in docs if grams(it) & grams(dt)}


def test_leaks_against_brute_force(spark):
    rng = random.Random(1)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(40))) for i in range(30)]
    docs = []
    for d in range(200):
        body = [rng.choice(WORDS) for _ in range(rng.randrange(5, 60))]
        if d % 3 == 0:
            w = items[rng.randrange(30)][1].split()
            k, n = rng.randrange(28), rng.choice([10, 11, 12, 13, 20])
            part = w[k:k + n]
            if d % 2:
                part[0] = "\\emph{" + part[0].upper() + "}"
                part[3] = part[3][:2] + "\\-" + part[3][2:] + ",\n% "
            body[2:2] = part
        docs.append((100 + d, " ".join(body)))
    want = leaks_brute(docs, items)
    assert len(want) > 15
    extra = [(900, None, "x"), (901, "", "x"), (902, items[0][1] * 400, "x")]
    df = spark.createDataFrame([(*d, "x") for d in docs] + extra, "doc_id long, text string, item_id string")
    it = spark.createDataFrame([(*i, "x") for i in items] + [(50, None, "x"), (51, "too short", "x"), (None, "q", "x")], "item_id long, text string, words string")
    for block in (1_000_000, 2_000):
        found = leaked_items(df, it, block_bytes=block).collect()
        assert {(r.item_id, r.doc_id) for r in found if r.exact >= 12} == want | {(0, 902)} | leaks_brute([(902, items[0][1] * 400)], items)
        assert len(found) == len({(r.item_id, r.doc_id) for r in found})
    assert {(r.item_id, r.doc_id) for r in leaked_items(df, it, edits=0).collect()} == want | {(0, 902)} | leaks_brute([(902, items[0][1] * 400)], items)
    assert leaked_items(df.where("false"), it).count() == 0 and leaked_items(df, it.where("false")).count() == 0


def test_edits_keep_the_bound():
    rng = random.Random(2)
    items = [" ".join(rng.choice(WORDS) for _ in range(30)) for _ in range(20)]
    ix = ItemIndex(list(range(20)), items, 12, 1)
    for i, t in enumerate(items):
        w = t.split()[5:18]
        w[6] = "unheard"
        assert i in ix.search("before it " + " ".join(w) + " and after")


def near(a, b):
    """Fewest words changed, left out or put in that make a of b."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(prev + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def near_brute(doc, item, n=12, edits=1):
    d, w = plain_words(doc).split(), plain_words(item).split()
    return any(near(w[k:k + n], d[i:i + m]) <= edits for k in range(len(w) - n + 1) for m in range(n - edits, n + edits + 1) for i in range(len(d) - m + 1))


def test_twelve_words_with_one_changed_against_brute_force():
    rng = random.Random(6)
    item = " ".join(rng.sample(WORDS, 20))
    ix, seen = ItemIndex([1], [item], 12, 1), set()
    for n in (10, 11, 12):
        for at in range(n):
            for kind in ("same", "changed", "left out", "put in", "twice"):
                w = item.split()[4:4 + n]
                if kind == "changed":
                    w[at] = "unheard"
                elif kind == "left out":
                    del w[at]
                elif kind == "put in":
                    w.insert(at, "unheard")
                elif kind == "twice":
                    w[at] = w[(at + 5) % n] = "unheard"
                doc = "before it " + " ".join(w) + " and after"
                want = near_brute(doc, item)
                seen.add((kind, n, want))
                assert (0 in ix.search(doc)) == want, (kind, n, at)
    assert ("changed", 12, True) in seen and ("changed", 11, False) in seen and ("put in", 11, False) in seen


def test_long_words_changed_or_put_in_against_brute_force():
    rng = random.Random(7)
    for long in (0, 30):
        # An item word of 30 letters makes the document's words of up to 30 letters move diagonals further than 16.
        item = " ".join([*rng.sample(WORDS, 20), *["l" * long] * bool(long)])
        ix = ItemIndex([1], [item], 12, 1)
        for n in (14, 15, 16, 31, 60, 400):
            for size in (11, 12):
                for at in range(1, size):
                    for put_in in (False, True):
                        w = item.split()[4:4 + size]
                        w[at:at + (not put_in)] = ["z" * n]
                        doc = "before it " + " ".join(w) + " and after"
                        assert (0 in ix.search(doc)) == near_brute(doc, item), (long, n, size, at, put_in)


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_recall_is_whole_for_changes_of_any_length(edits):
    rng, cases, hits = random.Random(edits), 0, 0
    alphabet = "abcdefgheijlmnoprstuvä" if edits < 2 else "абвгдеклмнопрст"
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    for _ in range(25):
        words = [word(rng.choice([1, 2, 3, 5, 8, 13])) for _ in range(24)]
        ix = ItemIndex([1], [" ".join(words)], 12, edits)
        for _ in range(12):
            at, n = rng.randrange(11), rng.choice([11, 12, 13])
            w = words[at:at + n]
            for _ in range(rng.randrange(edits + 2)):
                k, new = rng.randrange(len(w)), word(rng.randint(1, 40))
                w[k:k + rng.choice([0, 1])] = rng.choice([[new], []])
            doc = " ".join([word(4), word(9), *w, word(7), word(2)])
            want = near_brute(doc, " ".join(words), 12, edits)
            cases, hits = cases + want, hits + (want and 0 in ix.search(doc))
            assert (0 in ix.search(doc)) == want, (doc, words)
    assert cases > 50 and hits == cases


def test_short_words_before_a_changed_one():
    item = "a b cellar d e f g h i j k l m n o p q r s t"
    ix = ItemIndex([1], [item], 12, 1)
    for at in range(12):
        w = item.split()[:12]
        w[at] = "z" * 20
        doc = "before it " + " ".join(w) + " and after"
        assert (0 in ix.search(doc)) == near_brute(doc, item), at


# --- languages

TEXTS = {
    "en": "the field remains close to the bound and the chain is not far from the mean value of the drift in the limit",
    "de": "das feld bleibt nahe bei der schranke und die kette ist nicht weit von dem mittleren wert der strömung im grenzfall",
    "fr": "le champ reste proche de la borne et la chaîne est proche de la valeur moyenne de la dérive dans la limite",
    "ru": "поле остаётся близко к границе и цепь не далека от среднего значения сноса в пределе малых шагов",
}


@pytest.fixture(scope="module")
def labelled(spark):
    rng, rows = random.Random(4), []
    for k in range(240):
        c = list(TEXTS)[k % 4]
        w = TEXTS[c].split()
        label = {"en": "English", "de": "DE", "fr": "fre", "ru": "ru-RU"}[c]
        if k % 12 == 0:
            label = rng.choice(["xx", None, "", "en"])
        rows.append((k, "\n\n".join(" ".join(rng.choices(w, k=25)) for _ in range(3)), label, "x"))
    rows += [(900, None, "en", "x"), (901, "", None, "x"), (902, " ".join(TEXTS["en"].split() * 2) + "\n\n" + " ".join(TEXTS["en"].split()) + "\n\n" + " ".join(TEXTS["de"].split() * 2), None, "x"), (903, TEXTS["fr"] * 3000, "en", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, block_no string")


def test_languages(spark, labelled):
    got = label_languages(labelled).collect()
    main = {r.doc_id: r for r in got if r.block_no == -1}
    assert all(main[k].lang_code == list(TEXTS)[k % 4] for k in range(240))
    assert main[900].lang_code is None and main[900].confidence == 0.0 and main[901].lang_code is None
    assert [(r.block_no, r.lang_code) for r in got if r.doc_id == 902 and r.block_no >= 0] == [(2, "de")]
    assert main[903].lang_code == "fr" and all(0 <= r.confidence <= 1 for r in got)
    assert label_languages(labelled.where("false"), fit_languages(labelled)).count() == 0
    assert {r.lang_code for r in label_languages(labelled.drop("lang").withColumn("lang", labelled["doc_id"].cast("string"))).collect()} == {None}


def test_the_sample_is_drawn_from_labelled_rows_of_all_files(spark, tmp_path, monkeypatch):
    from barloom.llm import language

    # 70 files; Russian is in one of them only. One row in ten has a label.
    rows = [(f * 100 + k, TEXTS[c], c if k % 10 == 0 else None) for f in range(70) for k in range(20) for c in ["ru" if f == 11 else ("en", "de", "fr")[f % 3]]]
    schema = "doc_id long, text string, lang string"
    spark.createDataFrame(spark.sparkContext.parallelize(rows, 70), schema).write.parquet(str(tmp_path / "d"))
    docs, kept, write = spark.read.parquet(str(tmp_path / "d")), [], language.written
    assert len(docs.inputFiles()) == 70

    def counted(df, name):
        kept.append((out := write(df, name)).count())
        return out

    monkeypatch.setattr(language, "written", counted)
    assert fit_languages(docs, sample=200).codes == ["de", "en", "fr", "ru"] and kept == [140]
    monkeypatch.setattr(language, "LEAST", 2, raising=False)
    assert "ru" in fit_languages(docs, sample=60).codes and 30 < kept[1] < 100


def test_the_languages_are_those_of_the_labels(spark, tmp_path):
    texts = TEXTS | {"pl": "pole pozostaje blisko granicy a łańcuch nie jest daleko od średniej wartości dryfu w granicy małych kroków"}
    rows = [(k, "\n\n".join([texts[c]] * 3 + ["x" * 5000]), {"pl": "Polish", "de": "ger"}.get(c, c)) for k in range(200) for c in [list(texts)[k % 5]]]
    rows.append((900, texts["pl"], None))
    spark.createDataFrame(spark.sparkContext.parallelize(rows, 80), "doc_id long, text string, lang string").write.parquet(f"file://{tmp_path}/a b")
    docs = spark.read.parquet(f"file://{tmp_path}/a b")
    got = {r.doc_id: r for r in label_languages(docs).where("block_no = -1").collect()}
    assert len(docs.inputFiles()) == 80 and len(got) == 201
    assert all(got[k].lang_code == list(texts)[k % 5] == got[k].said for k in range(200)) and got[900].lang_code == "pl" and got[900].said is None


def test_unseen_words_back_off():
    grams = {"^ch": np.array([0.0, -3.0]), "sch": np.array([-1.0, -9.0]), "e": np.array([-2.0, -2.5])}
    m = LanguageModel(["de", "fr"], {}, grams)
    assert m.unknown("schloss").tolist() == [-1.0, -9.0] and m.unknown("e").tolist() == [-2.0, -2.5] and m.unknown("ж").tolist() == [0.0, 0.0]


def test_label_codes(spark):
    said = ["en_US", "EN", "English", "eng", "pt-BR", "dut", "xx", "", None, "unknown", " German ", "und"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i long, s string")
    got = [r.c for r in df.select("i", language_code(df["s"]).alias("c")).orderBy("i").collect()]
    assert got == ["en", "en", "en", "en", "pt", "nl", None, None, None, None, "de", None]


def test_prose_blocks():
    text = (
        "\\documentclass{a}\n\\title{No Prose \\emph{here} {at {all}}}\n\n\\begin{abstract}\nFirst words $x_{y}$ here.\n\\end{abstract}\n\n\\section{Head}\\label{a}\n\n% commented words\n% more\n\n"
        "Words \\cite{ref} with\\footnote{a note} 100\\% sure % not this\nend.\n\n\\begin{equation}\n a \\text{hidden}\n\\end{equation}\n\n\\begin{figure}\\caption{Nope}\\end{figure}\n\n"
        "\\begin{thebibliography}{9}\n\\bibitem{a} Hidden\n\n\\bibitem{b} also\n\\end{thebibliography}\n\nLast")
    assert prose_blocks(text) == [(1, ["first", "words", "here"]), (4, ["words", "with", "a", "note", "sure", "end"]), (9, ["last"])]
    assert prose_blocks(None) == [] and prose_blocks("") == []
