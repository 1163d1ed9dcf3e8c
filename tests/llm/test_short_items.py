"""Copies of short benchmark items are found, after other words, in other scripts and with few windows."""

from ratingloom.llm import template_decontamination

CAPITAL = "What is the capital of France?"
ITEMS = [
    (1, CAPITAL), (2, "Name two primes"), (3, "法国的首都是哪里？"), (4, "12 34 56 78 9 10 11 12 13 14"), (5, "What is 2 plus 3"),
    (6, None), (7, "?!"), (8, "Was ist größer"), (9, "Anna met Bob Carl Dora Emil Fritz"),
]
DOCS = [
    (1, "Question: " + CAPITAL), (2, "Question: What is the capital of Spain?"), (3, "Question: Where is the capital of France?"), (4, "x " + CAPITAL.upper() + " y"),
    (5, "Please name two primes, now"), (6, "问题：法国的首都是哪里？巴黎。"), (7, "法国的首都是"), (8, "List: 12 34 56 78 9 10 11 12 13 14 15"), (9, "12 34 56 78 9 10 11 12 13 15"),
    (10, "12 34 56 78 9 10 11 12 13 14.5"), (11, "tell me what is 2 plus 3."), (12, "“Was ist größer” — fragte er"), (13, "Rename two primes"), (14, ""), (15, None),
    (16, "anna met bob carl dora emil fritz"), (None, CAPITAL),
]


def _found(spark, docs=DOCS, items=ITEMS):
    out = template_decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    return {(r["doc_id"], r["item_id"]): (r["n_windows"], r["n_matched"], r["n_slots"], r["n_changed"]) for r in out.collect()}


def test_copies_of_short_items(spark):
    found = _found(spark)
    assert set(found) == {(1, 1), (2, 1), (4, 1), (5, 2), (6, 3), (8, 4), (11, 5), (12, 8), (16, 9)}
    assert found[1, 1] == (2, 2, 1, 0) and found[2, 1] == (2, 2, 1, 1) and found[4, 1] == (2, 2, 1, 0)
    assert found[6, 3] == (0, 0, 0, 0)


def test_cleaned_without_short_items(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    out = template_decontamination.cleaned(docs, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert sorted(r["doc_id"] or 0 for r in out.collect()) == [0, 3, 7, 9, 10, 13, 14, 15]
