"""The pipeline on planted cases, each stage against what it must keep, drop or change."""

import random

from tokenizers import Tokenizer

import corpus_pipeline as c
from periodica.llm.packing import tokenizer_path


def test_planted_cases(spark, tmp_path):
    r = random.Random(5)
    say = lambda n: " ".join("".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(3)) for _ in range(n))
    clean = [f"{say(40)}. {say(30)}." for _ in range(12)]
    item = say(30)
    near = clean[0].split()
    near[10] = "changed"
    texts = [*clean, clean[1], " ".join(near), f"{say(30)} {item}. {say(20)}.", f"{say(40)} password = hunter2hunter2 {say(9)}.", "junk", "a | b | c | d", None, ""]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    names = docs.columns
    for name, stage in c.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == names
        kept[name] = {x.doc_id: x.text for x in docs.collect()}
    assert sorted(kept["quality_rules"]) == list(range(16))
    assert sorted(kept["simhash_dedup"]) == [*range(12), 14, 15]
    assert sorted(kept["decontamination"]) == [*range(12), 15]
    assert sorted(kept["secret_scan"]) == [*range(12), 15] and "hunter2" not in kept["secret_scan"][15]
    assert all(kept["secret_scan"][k] == texts[k] for k in range(12))

    whole = Tokenizer.from_file(tokenizer_path())
    tokens = {k: len(whole.encode(t, add_special_tokens=False).ids) + 1 for k, t in kept["secret_scan"].items()}
    found = {}
    for x in c.run(spark, str(tmp_path)).collect():
        found[x.doc_id] = found.get(x.doc_id, 0) + x.length
    assert found == tokens


def test_hard_rows_and_empty_tables(spark, tmp_path):
    r = random.Random(6)
    say = lambda n: " ".join("".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(3)) for _ in range(n))
    a, b, c_, long = (f"{say(n)}. {say(12)}." for n in (30, 30, 30, 20_000))
    rows = [(1, a, 1, "x"), (1, a, 2, "x"), (2, b, None, None), (None, c_, 3, "y"), (None, c_, 4, "y"), (3, None, 5, "z"), (None, None, None, None), (4, "", 6, ""), (5, long, 7, "l"), (6, a + " ", 8, "copy")]
    schema = "doc_id long, text string, copies long, kept string"
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for some in (rows, []):
        docs = spark.createDataFrame(some, schema)
        for name, stage in c.STAGES[:-1]:
            at = f"{tmp_path}/{name}{len(some)}"
            stage(spark, docs, str(tmp_path)).write.parquet(at)
            docs = spark.read.parquet(at)
            assert docs.columns == ["doc_id", "text", "copies", "kept"]
        left = sorted((x.doc_id or 0, len(x.text)) for x in docs.collect())
        assert left == ([(0, len(c_)), (0, len(c_)), (1, len(a)), (2, len(b)), (5, len(long))] if some else [])
        packed = c.STAGES[-1][1](spark, docs, str(tmp_path))
        assert {x.doc_id for x in packed.collect()} == ({None, 1, 2, 5} if some else set())
