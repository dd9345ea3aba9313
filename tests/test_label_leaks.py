"""Labels inside texts, whatever stands at their ends, and marks of labels."""

from loomlight.operators import validation as V


def test_labels_of_any_length_and_with_marks_at_their_ends(spark):
    labels = ["short one", "word", "three of them", "a b c d e f g h", "one two three four five six seven eight nine ten"]
    texts = ["a short ones", "swords", "(three of them)", 'x "a b c d e f g h". y', '"One two  three\nfour five six seven eight nine ten!', "one two three four five six seven eight nine", None, ""]
    found = V.label_leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(labels)), "item_id long, text string"))
    plain = lambda t: " ".join((t or "").lower().split())
    assert {tuple(r) for r in found.collect()} == {(i, j) for i, t in enumerate(texts) for j, x in enumerate(labels) if plain(x) in plain(t)}


def test_marks_of_labels(spark):
    texts = ['{"incorrect_stages": []}', r"{\"unuseful_step_ids\" : 1}", '"labels": ["ok", "incorrect"]', "step_annotations_all/x.json", "merged_cleaned_step12\\\\a", "labels: incorrect", None]
    found = {tuple(r) for r in V.label_marks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert found == {(0, "key"), (1, "key"), (2, "array"), (3, "path"), (4, "path")}
