"""Columns of the input whose names an operator might use itself stay as they are."""

from foliant.llm import decontaminate, near, pii
from foliant.llm.tables import unused

NAMES = ["__id", "_id", "__H", "_h", "__v", "__maybe", "__part", "__later", "__rows", "__spans", "_spans", "_later", "_copies", "_check", "_place", "_bits", "comp", "node"]


def clashing(spark):
    long = " ".join(f"word{i}" for i in range(40))
    texts = [long, long, long + " more", "item words " + " ".join("abcdefghijklm"), "write to someone@example.org today", None]
    rows = [(i, t, *(100 * i + k for k in range(len(NAMES)))) for i, t in enumerate(texts)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} long" for n in NAMES))


def test_names_are_new_whatever_their_case(spark):
    _, docs = clashing(spark)
    made = unused(docs, "id", "h")
    assert len(set(made)) == 2 and not {m.lower() for m in made} & {c.lower() for c in docs.columns}


def test_rows_keep_their_values(spark):
    rows, docs = clashing(spark)
    benchmark = spark.createDataFrame([("x", " ".join("abcdefghijklm"))], "item_id string, text string")
    assert sorted(map(tuple, near.keep_first(docs).collect()), key=repr) == sorted((rows[i] for i in (0, 3, 4, 5)), key=repr)
    assert sorted(map(tuple, decontaminate.drop_contaminated(docs, benchmark).collect()), key=repr) == sorted((rows[i] for i in (0, 1, 2, 4, 5)), key=repr)
    redacted = {r.doc_id: tuple(r) for r in pii.redact_documents(docs).collect()}
    assert redacted[4] == (4, "write to <EMAIL> today", *rows[4][2:]) and redacted[0] == rows[0] and redacted[5] == rows[5]
