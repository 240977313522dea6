"""Queries over whole texts and tables, on tables that a cut would change."""

from millrace import catalogue


def run(spark, tmp_path, name, **tables):
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{table}.parquet")
    return [tuple(r) for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()]


def test_keywords_behind_400_characters(spark, tmp_path):
    docs = [(1, "x " * 300 + "WITH", "en", "s", 604)], "doc_id long, text string, lang string, source string, n_chars long"
    labels = [(1, 1, 0)], "doc_id long, quality int, toxic int"
    assert run(spark, tmp_path, "bad_feature_fscore", documents=docs, labels=labels) == [(1, 1.0)]


def test_long_documents_lose_nothing_in_packs(spark, tmp_path):
    docs = [(k, "w " * n, "en", "s", n) for k, n in enumerate((500, 3000, 523, 500))], "doc_id long, text string, lang string, source string, n_chars long"
    assert run(spark, tmp_path, "sequence_packing_stats", documents=docs) == [("s/0", 3, 4, 4523)]


def test_texts_are_joined_whole(spark, tmp_path):
    docs = [(1, "d" * 100 + "end")], "doc_id long, text string"
    items = [(1, "i" * 100 + "end"), (2, "alone")], "item_id long, text string"
    assert sorted(run(spark, tmp_path, "positional_join", documents=docs, benchmark=items)) == [(1, "i" * 100 + "end", "d" * 100 + "end"), (2, "alone", "")]


def test_later_lines_of_a_turn_are_normalised(spark, tmp_path):
    said = [(c, 1, "assistant", "first\n\n  reasoning : second \nOptimized_SMILES: C\nrest") for c in (2, 3)], "conv_id long, turn long, role string, text string"
    got = sorted(run(spark, tmp_path, "domain_normalised", conversations=said))
    assert got == [(2, 1, "reasoning : second\nOptimized SMILES: 2\n<END>"), (3, 1, "Reasoning: " + said[0][0][3] + "\nnoise\nOptimized SMILES: 3")]


def test_all_documents_are_mixed(spark, tmp_path):
    docs = [(k, "en") for k in range(70)], "doc_id long, lang string"
    chats = [(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string"
    assert sorted(run(spark, tmp_path, "mixed_corpus_counts", documents=docs, conversations=chats)) == [("chat", 1), ("cpt-en", 210)]
