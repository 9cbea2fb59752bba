import random
import re
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant.functions import batches, stemming
from foliant.operators import lexical, textindex

# Words and stems of the published sample vocabulary.
STEMS = """consign consign consigned consign consignment consign consist consist consistency consist consistently consist consolation consol
consolatory consolatori conspicuous conspicu conspiracy conspiraci conspirators conspir constables constabl constancy constanc knackeries
knackeri knaves knave knavish knavish kneeling kneel knightly knight knitting knit knives knive knotted knot caresses caress ponies poni
ties tie cries cri gas gas this this gaps gap kiwis kiwi agreed agre feed feed plastered plaster bled bled hopping hop hoping hope
happy happi say say by by relational relat conditional condit rational ration generously generous general general communication communic
arsenal arsenal skies sky dying die news news succeed succeed early earli inning inning organization organ nationalize nation
hopefulness hope formality formal analogies analog triplicate triplic adjustable adjust replacement replac adoption adopt probate probat
rate rate controll control roll roll yellow yellow enjoying enjoy boyish boyish""".split()


def test_published_stems():
    for word, stem in zip(STEMS[::2], STEMS[1::2], strict=True):
        assert stemming.stem(word) == stem
    assert [stemming.lexeme(w) for w in ("the", "running", "naïves", "x2", "é")] == [None, "run", "naïves", "x2", "é"]


def test_batches_are_cut_by_their_words():
    lists = [["a"] * 3, None, [], ["b"] * 9, ["c"], ["d", "e"], ["f"]]
    batch = pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.string())), pa.array(range(7))], ["words", "id"])
    parts = [*batches.by_words(batch, "words", 4)]
    assert [p.column("id").to_pylist() for p in parts] == [[0, 1, 2], [3], [4, 5, 6]]
    assert [w for p in parts for w in p.column("words").to_pylist()] == lists
    assert [p.num_rows for p in batches.by_words(batch.slice(0, 0), "words")] == [0]


def test_lexemes_keep_their_places(spark):
    rows = spark.createDataFrame([(1, ["the", "running", "dogs"]), (2, []), (3, None), (4, ["a", None])], "id long, words array<string>")
    assert {r.id: r.lexemes for r in stemming.with_lexemes(rows).collect()} == {1: [None, "run", "dog"], 2: [], 3: None, 4: [None, None]}
    assert stemming.with_lexemes(rows.limit(0)).collect() == []


def test_stems_by_expressions_are_the_same():
    import duckdb

    rng = random.Random(1)
    ends = ["", "s", "ed", "ing", "ly", "e", "y", *stemming.STEP2, *stemming.STEP3, *stemming.STEP4]
    made = {"".join(rng.choice("abcdegilnorstuvyz") for _ in range(rng.randint(1, 5))) + rng.choice(ends) for _ in range(5000)}
    words = sorted(made | set(STEMS) | set(stemming.WHOLE) | {"ümlaute", "a1s"})
    con = duckdb.connect()
    con.execute("create table w as select unnest(?) as word", [words])
    found = dict(con.execute(f"with {stemming.stem_sql('st', 'w')} select word, lexeme from st").fetchall())
    assert found == {w: stemming.lexeme(w) for w in words if w not in stemming.STOP_WORDS}


def sweep(places, clauses):
    """Minimal covers by the plain sweep: the nearest end at which a clause is held, then the last begin from which it is."""
    of = defaultdict(set)
    for lexeme, at in places:
        of[at].add(lexeme)
    wanted = {x for c in clauses for _, x in c}
    entries = sorted(at for at, xs in of.items() if xs & wanted)

    def held(low, high):
        return any(all(low <= first + off <= high and x in of.get(first + off, ()) for off, x in c) for c in clauses for first in range(low, high + 1))

    out, begin = [], 0
    while begin < len(entries):
        end = next((e for e in range(begin, len(entries)) if held(entries[begin], entries[e])), None)
        if end is None:
            break
        start = next(b for b in range(end, begin - 1, -1) if held(entries[b], entries[end]))
        out.append((entries[start], entries[end], end - start + 1))
        begin = start + 1
    return out


def brute_density(words, n_title, clauses):
    lexemes = [stemming.lexeme(w) for w in words]
    places = [(x, i + 1) for i, x in enumerate(lexemes) if x is not None]
    raw = 0.0
    of = dict((at, x) for x, at in places)
    wanted = {x for c in clauses for _, x in c}
    covers = sweep(places, clauses)
    for low, high, n in covers:
        weights = [1.0 if at <= n_title else 0.4 for at in range(low, high + 1) if of.get(at) in wanted]
        raw += n / sum(1 / w for w in weights) / (1 + high - low + 1 - n)
    return (round(raw / (raw + 1), 9), len(covers)) if covers else None


def brute_clauses(question):
    from_quotes = re.findall('"([^"]+)"', question)
    clauses = set()
    for clause in [*from_quotes, *re.sub('"[^"]+"', " ", question).split()]:
        placed = [(i, stemming.lexeme(w)) for i, w in enumerate(re.findall(r"\w+", clause.lower()))]
        placed = [(i, x) for i, x in placed if x is not None]
        if placed:
            clauses.add(tuple((i - placed[0][0], x) for i, x in placed))
    return clauses


def test_cover_density_against_a_sweep(spark, tmp_path):
    rng = random.Random(3)
    pool = ["alpha", "betas", "gammas", "the", "of", "running", "dogs", "delta"]
    docs = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 3))), " ".join(rng.choice(pool) for _ in range(rng.randint(0, 25)))) for i in range(60)]
    questions = [
        (1, "alpha gamma"), (2, '"alpha beta" gamma'), (3, '"alpha of beta" dog'), (4, '"alpha beta" alpha'), (5, '"alpha beta gamma" "beta gamma"'),
        (6, '"dog the running delta" "delta alpha"'), (7, "the of"), (8, '"the alpha" "dogs run"'), (9, '"alpha of beta" "gamma delta"'), (10, "alpha-beta dogs"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, title string, text string")
    index = textindex.write_index(textindex.analyzed(df, F.col("title")), str(tmp_path / "index"), 7)
    parsed = lexical.parse_questions(spark.createDataFrame(questions, "query_id long, question string"))
    found = {(r.query_id, r.doc_id): (r.fts_score, r.covers) for r in textindex.cover_density(index, textindex.clause_parts(parsed), 1000).collect()}
    want = {}
    for q, text in questions:
        for i, title, body in docs:
            words = re.findall(r"\w+", f"{title} {body}")
            if (got := brute_density(words, len(title.split()), brute_clauses(text))) is not None:
                want[q, i] = got
    assert found == want and len({q for q, _ in want}) == 9


@pytest.mark.parametrize("stems", [True, False])
def test_best_documents_are_those_of_all_pairs(spark, tmp_path, stems):
    rng = random.Random(4)
    pool = [f"w{i}ing" for i in range(40)] + ["common"] * 10
    docs = [(i, " ".join(rng.choice(pool) for _ in range(rng.choice([1, 3, 20, 400])))) for i in range(400)] + [(900, None), (901, ""), (5, "w1ing w2ing")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    index = textindex.write_index(textindex.analyzed(df, stems=stems), str(tmp_path / "index"), 8)
    queries = [(q, " ".join(rng.choice(pool) for _ in range(rng.randint(1, 12)))) for q in range(12)] + [(50, "common"), (51, "absent"), (52, "the"), (53, None)]
    terms = textindex.lexemes_of(spark.createDataFrame(queries, "query_id long, text string"), stems=stems)
    found = [(r.query_id, r.lexical_rank, r.doc_id, r.fts_score) for r in textindex.best_documents(index, terms, 10).collect()]
    name = stemming.lexeme if stems else (lambda w: w)
    words = defaultdict(list)
    for i, t in docs:
        words[i] += [name(w) for w in re.findall(r"\w+", (t or "").lower())]
    want = []
    for q, t in queries:
        asked = {name(w) for w in re.findall(r"\w+", t or "")} - {None, "the"}
        raw = {i: 0.4 * sum(w in asked for w in ws) for i, ws in words.items()}
        best = sorted(((-round(r / (r + 1), 9), i) for i, r in raw.items() if r))[:10]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(found) == sorted(want)
    biggest = index.select(F.max(F.size("entries"))).first()[0]
    assert biggest <= 40 and index.filter("lexeme = 'common'").count() > 10  # a common word's documents are in many rows


def test_an_index_for_known_questions_analyzes_texts_once(spark, tmp_path):
    """Texts were analyzed twice, and postings written that no question meets."""
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) for _ in range(rng.randint(1, 30)))) for i in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = textindex.analyzed(df).mapInArrow(counted, textindex.analyzed(df).schema)
    parts = textindex.clause_parts(lexical.parse_questions(spark.createDataFrame([(1, '"alpha beta" gamma'), (2, "delta")], "query_id long, question string")))
    asked = parts.select(F.explode("parts.lexeme").alias("lexeme"))
    part = textindex.write_index(rows, str(tmp_path / "part"), only=asked)
    assert seen.value == 80
    whole = textindex.write_index(textindex.analyzed(df), str(tmp_path / "whole"))
    assert part.select("lexeme").distinct().count() == 4 and whole.select("lexeme").distinct().count() == 5
    found = [sorted(map(tuple, textindex.cover_density(index, parts, 100).collect())) for index in (part, whole)]
    assert found[0] == found[1] and len(found[0]) > 80


def test_an_empty_index(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    index = textindex.write_index(textindex.analyzed(df), str(tmp_path / "index"))
    terms = textindex.lexemes_of(spark.createDataFrame([(1, "alpha")], "query_id long, text string"))
    assert textindex.best_documents(index, terms).collect() == []


def test_inverted_rows_hold_places_in_order_and_rows_without_words_give_none(spark):
    rows = spark.createDataFrame(
        [(1, 7, 2, ["b", None, "a", "b"]), (2, 7, 0, []), (3, 7, 0, None), (4, 7, 0, [None, None]), (1, 7, 0, ["b"])],
        "doc_id long, block long, n_title int, lexemes array<string>",
    )
    found = {(r.lexeme, r.doc_id, r.n_title, round(r.weight, 9), tuple(r.places)) for r in textindex.inverted(rows).collect()}
    assert found == {("b", 1, 2, 1.4, (1, 4)), ("a", 1, 2, 0.4, (3,)), ("b", 1, 0, 0.4, (1,))}
    assert textindex.inverted(rows.limit(0)).count() == 0


def test_rows_of_one_id_count_together_in_a_block_bound(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, ["a", "a"]), (1, 1, ["a", "a"]), (2, 0, ["a", "b"])], "doc_id long, n_title int, lexemes array<string>")
    index = textindex.write_index(rows, str(tmp_path / "index"), docs_per_block=8)
    a = index.filter("lexeme = 'a'").first()
    total = sum(e.weight for e in a.entries if e.doc_id == 1)
    assert (a.docs, len(a.entries)) == (2, 3) and a.max_weight >= total - 1e-9
    terms = spark.createDataFrame([(5, "a")], "query_id long, lexeme string")
    assert [(r.doc_id, r.lexical_rank) for r in textindex.best_documents(index, terms, 1).collect()] == [(1, 1)]
