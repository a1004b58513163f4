"""The pipeline against plain Python, stage by stage."""

import random

import public_tokenizers
from tests.llm.test_dedup_operators import components, deduped
from tests.llm.test_text_operators import hits

ITEM = "benchmark question number one asks which of these many words comes last in line"


def tables(spark, folder):
    rng = random.Random(4)
    vocabulary = [f"{a}{b}" for a in ("stone", "river", "lamp", "cloud", "north", "quiet") for b in ("ing", "er", "ed", "s", "ly", "")]
    sentence = lambda: " ".join(rng.choice(vocabulary) for _ in range(12))
    rows = []
    for i in range(60):
        rows.append((i, "\n".join(sentence() for _ in range(8))))
    rows.append((60, rows[3][1] + "\nwith one more line of quite different words than before"))
    rows.append((61, rows[4][1]))
    for i in (62, 63):
        rows.append((i, "a boilerplate line that two documents share\n" + "\n".join(sentence() for _ in range(8))))
    rows.append((64, sentence() + "\n" + ITEM + "\n" + "\n".join(sentence() for _ in range(8))))
    for i in range(65, 80):
        rows.append((i, " | ".join(f"{rng.choice(vocabulary)}***" for _ in range(90))))
    rows += [(80, None), (81, ""), (82, "far too short")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)] + [(i, 0, 0) for i in range(65, 80, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return dict(rows)


def test_stages_do_what_they_say(spark, tmp_path):
    import corpus_pipeline

    texts = tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        seen.append(name)
        columns = docs.columns
        out = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = {r.doc_id: r.text for r in docs.collect()} if name != "pack" else None
        if name == "quality_rules":
            assert set(after) == {i for i in texts if i < 65}
        elif name == "line_dedup":
            assert after == {int(i): t for i, _, _, t in deduped(list(before.items()))}
        elif name == "near_dedup":
            parts = components(list(before.items()), 5, 80)
            assert set(after) == {i for i in before if parts[i] == i}
        elif name == "decontaminate":
            for i, t in before.items():
                n, hit, _ = hits(t, [(1, ITEM)], 10)
                assert (i in after) == (hit <= 0.8 * n)
                assert i not in after or hits(after[i], [(1, ITEM)], 10)[1] == 0
                assert i not in after or hit or after[i] == t
    assert seen == ["quality_rules", "line_dedup", "near_dedup", "decontaminate", "pack"]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = docs.groupBy("doc_id").sum("length").collect()
    last = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/decontaminate").collect()}
    assert {r[0]: r[1] for r in packed} == {i: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for i, x in last.items()}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
