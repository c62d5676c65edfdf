"""The pipeline's stages against brute force."""

import re
from collections import Counter

import corpus_pipeline as P

from .conftest import prose
from .test_operators import brute_components, brute_hits


def test_stages(spark, tmp_path):
    good = [prose(i, 120) for i in range(8)]
    item = prose(77, 60)
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(good)]
    rows += [(20, good[0], "en", "s", 1), (21, good[1] + " tail", "en", "s", 1), (22, prose(30, 80) + " " + item + " " + prose(31, 80), "en", "s", 1), (23, item + " " + prose(32, 30), "en", "s", 1)]
    rows += [(24, prose(33, 100) + " token = Zx9kQ2mVt7Lp4RwB8nYc3HsD6fJg1KaE end", "en", "s", 1), (25, "spam " * 100, "en", "s", 1), (26, "short", "en", "s", 1), (27, None, None, None, None), (0, good[0], "en", "s", 7)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(8)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality rules", "near dedup", "decontamination", "secret scan", "packing"]
    inputs = [docs]
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, inputs[-1], str(tmp_path))
        assert out.dtypes == docs.dtypes, name
        out.write.parquet(f"{tmp_path}/{name}")
        inputs.append(spark.read.parquet(f"{tmp_path}/{name}"))
    kept = [Counter(r["doc_id"] for r in x.collect()) for x in inputs]
    assert set(kept[0]) - set(kept[1]) == {25, 26, 27}
    pairs = [(r["doc_id"], r["text"]) for r in inputs[1].collect()]
    assert kept[2] == Counter({d for (d, _, c, k) in brute_components(pairs) if k}) and {20, 21} & set(kept[2]) == set()
    texts = [{r["doc_id"]: r for r in x.collect()} for x in inputs]
    for d, r in texts[2].items():
        hit = brute_hits(r["text"], [(1, item)])
        if not hit[1]:
            assert texts[3][d]["text"] == r["text"]
        elif d in texts[3]:
            assert not brute_hits(texts[3][d]["text"], [(1, item)])[1]
            assert texts[3][d]["n_chars"] == len(texts[3][d]["text"])
    assert 22 in texts[3] and 23 in texts[2] and 23 not in texts[3]
    for d, r in texts[3].items():
        assert texts[4][d]["text"] == re.sub(r"token = \S+", "[SECRET]", r["text"])
    packed = P.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.collect()} == set(kept[4])
    tokens = packed.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert all(r[1] == r[2] for r in tokens)


def test_short_items_are_cut(spark, tmp_path):
    """An item of fewer words than a window goes from longer texts too; a part of it stays."""
    item, half = "quartz zephyr owns nine violet lanterns", "quartz zephyr owns nine"
    texts = {1: f"{prose(1, 80)} {item}. {prose(2, 80)}", 2: f"{prose(3, 80)} {half} {prose(4, 80)}", 3: f"{item} {prose(5, 60)}"}
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], columns)
    spark.createDataFrame([(1, item), (2, prose(77, 60))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in P.decontamination(spark, docs, str(tmp_path)).collect()}
    assert {i: r["text"] for i, r in got.items()} == {i: t.replace(item, "") for i, t in texts.items()}
    assert all(r["n_chars"] == len(r["text"]) and not brute_hits(r["text"], [(1, item)])[1] for r in got.values())


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, kept int, clean string, n_words string, text_hash string, j_id string"


def _tables(spark, folder, labels, items):
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_stages_of_empty_tables(spark, tmp_path):
    _tables(spark, tmp_path, [], [])
    docs = spark.createDataFrame([], COLUMNS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes and out.count() == 0, name
    assert P.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_what_is_not_theirs(spark, tmp_path):
    """Nulls in any column, empty texts, repeated rows and columns with names that the operators use themselves."""
    _tables(spark, tmp_path, [(1, 1, 0), (2, 1, 0), (None, None, None)], [(1, prose(77, 60)), (2, None), (None, "")])
    rows = [(i, prose(i, 120), "en", "s", 5, "r", 7, "c", "w", "h", "j") for i in (1, 2)] + [(3, *[None] * 10), (4, "", None, "s", 0, None, 1, None, None, "h", None), (None, prose(9, 120), *[None] * 9)]
    docs = spark.createDataFrame(rows + rows[:1], COLUMNS)
    got = {name: [tuple(r) for r in stage(spark, docs, str(tmp_path)).collect()] for name, stage in P.STAGES[:-1]}
    good = [r for r in rows if r[1]]

    def same(found, wanted, but=()):
        keep = [i for i, c in enumerate(docs.columns) if c not in but]
        return Counter(tuple(r[i] for i in keep) for r in found) == Counter(tuple(r[i] for i in keep) for r in wanted)

    assert same(got["quality rules"], good + rows[:1])
    assert same(got["near dedup"], rows)
    for name in ("decontamination", "secret scan"):
        assert same(got[name], rows + rows[:1], ("n_chars",)), name
        assert all(r[4] == (None if r[1] is None else len(r[1])) for r in got[name])
    pieces = P.packing(spark, docs, str(tmp_path)).collect()
    assert sum(r["length"] for r in pieces if r["doc_id"] in (3, 4)) == 2 and Counter(r["doc_id"] for r in pieces)[1] >= 2
