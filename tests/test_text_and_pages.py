import hashlib
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import chunking, cleaning, numbering
from foliant.plans import page_queries


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_exact_signals_and_strong_tokens(spark):
    words = ["AI", "NIST", "ISO/IEC", "word", "42", "A1", "C++", "Rmf"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.is_exact_signal(F.col("w")).alias("e"), T.is_strong_token(F.col("w")).alias("s")).collect()
    assert {r.w for r in rows if r.e} == {"NIST", "ISO/IEC", "C++"}
    assert {r.w for r in rows if r.s} == {"AI", "NIST", "ISO/IEC", "42", "A1", "C++"}


def test_jaccard_of_empty_sets(spark):
    empty, some = T.word_set(F.lit("")), T.word_set(F.lit("a b c"))
    r = one(spark, both=T.jaccard(empty, empty), summary=T.jaccard(empty, empty, 0.0), one=T.jaccard(empty, some), half=T.jaccard(some, T.word_set(F.lit("B c d"))))
    assert (r.both, r.summary, r.one, r.half) == (1.0, 0.0, 0.0, 0.5)


@pytest.mark.parametrize(
    "quote,expected",
    [("one two", True), ("one ... four", True), ("four … one", False), ("ONE, two!", True), ("five", False), ("...", False), ("wo three", True)],
)
def test_quotes(spark, quote, expected):
    assert one(spark, ok=T.quote_supported(F.lit(quote), F.lit("Zero one-two three; four."))).ok is expected


def test_clauses_split_at_contrasts_but_not_in_lists(spark):
    texts = {
        "The bank was closed and the shop was open": 2, "Govern, Map, Measure, and Manage are parts": 1, "it rains but we go": 2, "salt and pepper": 1,
    }
    for text, n in texts.items():
        assert one(spark, n=F.size(T.clauses(F.lit(text)))).n == n


def test_headings(spark):
    yes = ["1.2 Scope of Work", "EXECUTIVE SUMMARY", "Risk and Impact of Models", "Chapter 3 Results"]
    no = ["This is a sentence.", "12 monkeys", "Note: this", "- item", "lower case words", "Dr. Who", ""]
    rows = spark.createDataFrame([(x,) for x in yes + no], "x string").select("x", T.is_heading(F.col("x")).alias("h")).collect()
    assert {r.x for r in rows if r.h} == set(yes)


def test_folding_lines(spark):
    fold = lambda text: one(spark, t=cleaning.fold_lines(F.split(F.lit(text), "\n", -1))).t
    assert fold("A long line of prose that was wrapped by\nthe page width here.\n\nNext   one") == "A long line of prose that was wrapped by the page width here.\n\nNext one"
    assert fold("this is an auto-\nmatic thing") == "this is an automatic thing"
    assert fold("1. first item of the list is here okay\n2. second") == "1. first item of the list is here okay\n2. second"
    long = "x" * 90
    assert fold(f"{long}\n\n25\n\n{long}\n\n25") == f"{long}\n\n25\n\n25"
    assert fold("") == ""


def test_recurring_edges_go_from_later_pages(spark):
    rows = [("f", n, f"Annual Report\nbody of page {n} says this\nmore text {n * 7}\n{n}", None) for n in range(1, 6)]
    rows += [("g", 1, "", "broken"), ("g", 2, "Tiny", None), ("g", 3, None, None)]
    pages = spark.createDataFrame(rows, "file string, page_number int, raw_text string, extraction_error string")
    found = {(r.file, r.page_number): r for r in cleaning.clean_pages(pages).collect()}
    assert found["f", 1].cleaned_text.startswith("Annual Report") and "Annual" not in found["f", 2].cleaned_text
    assert found["f", 3].removed_headers == ["Annual Report"] and found["f", 3].removed_footers == ["3"]
    assert found["g", 1].warnings == ["extraction-error", "empty-page"] and found["g", 2].warnings == ["low-text-page"]
    totals = {r.file: r for r in cleaning.summary(cleaning.clean_pages(pages)).collect()}
    assert totals["f"].pages == 5 and totals["g"].pages_with_warnings == 3


def test_edges_of_a_file_with_very_many_keys(spark):
    """A page meets only its own keys, so no row or task holds all those of a file."""
    rows = [("hot", n, f"Title {n // 2}\n \nCommon   LINE\nbody {n}\nlast of {n // 3}\n{n}") for n in range(1, 601)]
    rows += [("hot", 7, "common line\nother text\nof page 7"), ("cold", 1, "common line\nx\ny\nz"), ("cold", 5, "common line\nx\ny\nz"), ("cold", None, "common line\nk\ny\nz"), ("cold", 6, None), (None, 3, "common line")]
    rows += [("cold", 8, "common" + " " * 130 + "line\n\t\nk\nl\nm"), ("one", 2, "only line")] * 2
    pages = spark.createDataFrame(rows, "file string, page_number int, raw_text string")
    heads, feet = (cleaning.repeated_edges(pages, start, 2, 0.0) for start in (True, False))
    known = [{(r.file, r.key) for r in found.collect()} for found in (heads, feet)]
    key = lambda x: "<page-number>" if (k := " ".join(x.lower().split())).removeprefix("page").strip().isdigit() else k

    def plain(file, page, text):
        every, out = (text or "").split("\n"), ([], [], [])
        full = [i for i, x in enumerate(every) if x.strip(" ")]
        for i, x in enumerate(every):
            head, foot = (i in at and (file, key(x)) in found for at, found in zip((full[:2], full[-2:]), known, strict=True))
            role = 0 if page == 1 or not x.strip(" ") else 1 if head else 2 if foot else 0
            out[role].append(x if role == 0 else x.strip(" "))
        return file, page, text, *out

    done = cleaning.remove_edges(pages, heads, feet)
    assert done.columns == [*pages.columns, "kept", "removed_headers", "removed_footers"]
    found = sorted(map(tuple, done.collect()), key=repr)
    assert found == sorted((plain(*r) for r in rows), key=repr) and sum(len(r[4]) for r in found) > 1000
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    gathered = [line for line in plan.splitlines() if "collect_set" in line]
    assert gathered and all("__page" in line.split("]")[0] for line in gathered)


def test_edges_of_a_page_with_very_many_lines(spark):
    """A page's lines are looked at once each: edges were found again for every line. A long line may have a short one's key, if it has no more than twice its characters."""
    body = "\n".join(str(n) for n in range(20_000))
    rows = [("f", n, f"Top\n{body}\nEnd") for n in (1, 2, 3)]
    rows += [("g", n, text) for n, text in enumerate(("x", "ß" * 120 + "\ny", "ß" * 120 + "\nz", "s" * 240 + "\nu\nv\nw", "s" * 241 + "\nu\nq\nr", "\nk"), 1)]
    pages = cleaning.with_edges(spark.createDataFrame(rows, "file string, page_number int, raw_text string"))
    began = time.time()
    done = cleaning.remove_edges(pages, *(cleaning.repeated_edges(pages, start, 2, 0.0) for start in (True, False)))
    found = {(r.file, r.page_number): (len(r.kept), r.removed_headers, r.removed_footers) for r in done.collect()}
    assert time.time() - began < 60 and done.columns == ["file", "page_number", "raw_text", "kept", "removed_headers", "removed_footers"]
    assert found["f", 1] == (20_002, [], []) and found["f", 2] == found["f", 3] == (19_998, ["Top", "0"], ["19999", "End"])
    assert found["g", 2] == found["g", 3] == (1, ["ß" * 120], []) and found["g", 4] == (2, ["s" * 240, "u"], []) and found["g", 5] == (3, ["u"], [])


def test_spacing_penalty_and_samples(spark):
    r = one(
        spark, s=T.normalized_spacing(F.lit("a\r\nb\rc d\x03e")), p=T.quality_penalty(F.lit("�� Th\nese are")),
        best=cleaning.best_text(F.lit("Th\nese"), F.lit("These")), pages=cleaning.sample_pages(F.lit(10)),
    )
    assert r.s == "a\nb\nc de" and r.p == 21 and r.best == "These" and r.pages == [1, 2, 5, 8, 10]


def test_chunks_of_a_file(spark):
    body = "RISK SECTION\nFirst paragraph about risk. " + "Some words follow here. " * 60 + "\n\n- item one\n- item two"
    pages = spark.createDataFrame([("f", 1, body), ("f", 2, "Second page goes on in the same section.\n\nOTHER PART\nThe end is here."), ("g", 1, "word " * 900), ("h", 1, "")], "file string, page_number int, cleaned_text string")
    rows = sorted(chunking.chunk_pages(pages, chunking.ChunkSize(120, 20, 25)).collect(), key=lambda r: (r.file, r.chunk_index))
    assert {r.file for r in rows} == {"f", "g"} and all(r.token_count <= 120 for r in rows)
    f = [r for r in rows if r.file == "f"]
    assert {r.section_title for r in f} == {"RISK SECTION", "OTHER PART"} and f[-1].page_start == 2
    assert any("list-item" in r.boundary_kinds for r in f) and any(r.overlap_token_count for r in f)
    assert all(r.content.startswith("[Source page") for r in rows)
    words = sum(r.token_count - chunking.count(chunking.label(r.page_start, r.page_end, r.section_title)) - r.overlap_token_count for r in rows if r.file == "g")
    assert words >= 105  # equal chunks of one file are one
    fields = {"chunking_version": chunking.VERSION, "page_end": f[0].page_end, "page_start": f[0].page_start, "passage_text": f[0].passage_text, "section_title": f[0].section_title}
    canonical = json.dumps(fields, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert f[0].content_hash == hashlib.sha256(canonical.encode()).hexdigest()
    with pytest.raises(ValueError):
        chunking.ChunkSize(10, 10, 0)


def test_packing_moves_units_into_short_chunks():
    unit = lambda n, s="a": chunking.Unit("w " * n, 1, 1, s, "paragraph")
    size = chunking.ChunkSize(70, 10, 30)
    groups = chunking.pack([unit(20), unit(15), unit(15), unit(15)], size)
    assert [len(g) for g in groups] == [2, 2]
    assert [len(g) for g in chunking.pack([unit(20), unit(5, "b")], size)] == [1, 1]


def test_character_chunks_keep_the_tail(spark):
    pages = spark.createDataFrame([("f", 1, "A" * 120 + "\n\n" + "B" * 120)], "file string, page_number int, cleaned_text string")
    rows = sorted(chunking.character_chunks(pages, 80, 20).collect(), key=lambda r: r.chunk_index)
    assert len(rows) > 2 and all(r.content.startswith("[Source page 1]\n") for r in rows)
    with pytest.raises(ValueError):
        chunking.character_chunks(pages, 10, 10)


def test_evidence_patterns(spark):
    chunks = spark.createDataFrame([("f", 0, 1, 2, "Safe–guards are Needed"), ("f", 1, 3, 3, "safe-guards")], "file string, chunk_index int, page_start int, page_end int, passage_text string")
    wanted = spark.createDataFrame([("q", "f", [2], [["safe-guard", "need"]]), ("r", "f", [3], [["nothing"], ["guards"]])], "id string, file string, pages array<int>, pattern_groups array<array<string>>")
    assert sorted(map(tuple, chunking.matching_chunks(chunks, wanted).collect())) == [("q", "f", 0), ("r", "f", 1)]


def test_runs_of_a_file_are_chunked_apart_and_give_the_chunks_of_the_whole(spark, monkeypatch):
    rng = random.Random(12)
    heads = ["First Part", "Second Part", "Third Part", "1.2 Something Else"]
    pages = []
    for file in ("a", "b", None):
        for number in range(1, 40):
            body = []
            for _ in range(rng.randint(0, 4)):
                if rng.random() < 0.25:
                    body.append(rng.choice(heads))
                words = " ".join(rng.choice(["alpha", "beta", "gamma."]) for _ in range(rng.randint(1, 60)))
                body.append(f"- {words}\n- more" if rng.random() < 0.2 else words + " end.")
            pages.append((file, number, "\n\n".join(body)))
    df = spark.createDataFrame(pages, "file string, page_number int, cleaned_text string")
    size = chunking.ChunkSize(60, 10, 15)

    def whole():
        """The units of a file in order, packed as one list."""
        rows = sorted(chunking.units(df).collect(), key=lambda r: (r.file is None, r.file or "", r.page_number, r.paragraph, r.item))
        out = []
        for file in ("a", "b", None):
            own = [(r.page_number, r.text, r.section, r.kind) for r in rows if r.file == file]
            seen = set()
            for c in chunking._chunk_run((file, None, None), own, size):
                key = (c[4], *c[6:9])
                if key not in seen:
                    seen.add(key)
                    out.append((c[0], *c[3:]))
        return sorted(map(repr, out))

    names = ["file", "chunk_index", "passage_text", "content", "page_start", "page_end", "section_title", "token_count", "overlap_token_count", "boundary_kinds"]
    for pages_per_block in (1, 7, 1000):
        monkeypatch.setattr(chunking, "PAGES_PER_BLOCK", pages_per_block)
        assert sorted(repr(tuple(r)) for r in chunking.chunk_pages(df, size).select(*names).collect()) == whole()
    runs = chunking.units(df).select("file", "run").distinct().count()
    assert runs > 20  # so many groups of their own


def test_values_and_sums_go_on_over_blocks(spark):
    rng = random.Random(13)
    rows = [(rng.choice(["x", "y", None]), i, rng.choice([None, None, rng.randint(0, 9)])) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, i int, v int")
    last, total, want = {}, {}, {}
    for g, i, v in rows:
        before = last.get(g)
        last[g] = v if v is not None else before
        want[i] = (last[g], before, total.get(g, 0))
        total[g] = total.get(g, 0) + (v or 0)
    for step in (1, 9, 500):
        block = F.floor(F.col("i") / step)
        found = numbering.carried(df, "g", block, ["i"], F.col("v"), "c")
        assert {r.i: (r.c, r.c_before) for r in found.collect()} == {i: w[:2] for i, w in want.items()}
        sums = numbering.sums_before(df.fillna(0, ["v"]), "g", block, ["i"], "v", "s")
        assert {r.i: r.s for r in sums.collect()} == {i: w[2] for i, w in want.items()}


def test_the_best_size_keeps_evidence_and_has_no_copies(spark):
    rows = [("a", 0, 3), ("b", 0, 1), ("c", 0, 1), ("d", 1, 0), ("e", 0, 0)]
    summaries = spark.createDataFrame(rows, "configuration string, duplicate_hashes int, near_pairs int")
    scores = spark.createDataFrame([("a", 300, 5, 5), ("b", 200, 5, 5), ("c", 310, 5, 5), ("d", 300, 5, 5), ("e", 300, 5, 4)], "configuration string, most int, cases int, preserved int")
    assert [r[0] for r in chunking.best_size(summaries, scores).collect()] == ["c"]
    assert chunking.best_size(summaries, scores.filter("configuration = 'e'")).collect() == []


def test_a_sweep_parses_pages_once_and_gives_the_chunks_of_each_size(spark, monkeypatch):
    draw, parsed, units = random.Random(5), [], chunking.units
    monkeypatch.setattr(chunking, "units", lambda pages: parsed.append(1) or units(pages))
    body = lambda: "\n\n".join(draw.choice(["1.1 Some Title", "- an item\n- another one", "Plain words " * draw.randint(1, 40) + "end."]) for _ in range(6))
    pages = spark.createDataFrame([(f, p, body()) for f in ("a", "b") for p in range(1, 7)], "file string, page_number int, cleaned_text string").persist()
    sizes = [chunking.ChunkSize(60, 10, 12), chunking.ChunkSize(120, 0, 30)]
    swept = chunking.chunk_sweep(pages, sizes)
    assert len(parsed) == 1
    rows = [r.asDict() for r in swept.collect()]
    for k, size in enumerate(sizes):
        own = sorted(map(str, (r.asDict() for r in chunking.chunk_pages(pages, size).collect())))
        assert own == sorted(str({c: v for c, v in r.items() if c != "setting"}) for r in rows if r["setting"] == k) and len(own) > 6


def test_a_file_that_is_a_row_gives_the_chunks_and_summary_of_its_pages(spark):
    draw, sizes = random.Random(8), [chunking.ChunkSize(60, 10, 12), chunking.ChunkSize(120, 0, 30)]
    blocks = ["1.1 Some Title", "Other Part", "- an item\n- another one", "“Curly” Σίγμα 日本 😀 end.", " \n", "Plain wörds. " * 3]
    body = lambda: "\n\n".join(draw.choice([*blocks, "many " * draw.randint(1, 200)]) for _ in range(draw.randint(0, 6)))
    files = [(f, [body() for _ in range(draw.randint(1, 9))]) for f in ("a", "b", None, "c")] + [("copies", ["Title\n\n" + "same " * 45 + "\n\nTitle Two\n\n" + "other " * 50] * 3), ("empty", [" "]), ("none", None)]
    rows = spark.createDataFrame(files, "file string, pages array<string>").coalesce(1)
    pages = rows.select("file", F.posexplode("pages").alias("at", "cleaned_text")).select("file", (F.col("at") + 1).alias("page_number"), "cleaned_text")
    swept = chunking.chunk_sweep(pages, sizes).persist()
    names = ["setting", "file", "chunk_index", "passage_text", "page_start", "page_end", "section_title", "token_count", "overlap_token_count", "boundary_kinds"]
    every = sorted(repr(tuple(r)) for r in swept.select(*names).collect())
    summary = lambda made: sorted(map(tuple, made.collect()))
    for characters in (chunking.CHARACTERS, 1000, 1):  # long files are several rows
        found = chunking.chunk_files(rows, sizes, characters)
        own = found.select("setting", "file", F.inline("chunks")).select(*names)
        assert sorted(repr(tuple(r)) for r in own.collect()) == every and len(every) > 40
        assert summary(chunking.summarize_files(found, F.col("setting"))) == summary(chunking.summarize(swept, F.col("setting")))
    twice = spark.createDataFrame([("a", ["some text"]), ("a", ["some text"])], "file string, pages array<string>").coalesce(1)
    assert chunking.chunk_files(twice, sizes[:1]).count() == 2  # each row is a file


def test_the_sweep_of_chunk_sizes_writes_and_deals_out_no_text(spark, monkeypatch):
    def stored(*_):
        raise AssertionError("texts were written")

    monkeypatch.setattr(chunking, "stored", stored)
    plan = page_queries.chunk_sizes(spark, "/root/testdata/sf0.001")
    assert len(plan.collect()) == 3
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert not any(word in text for word in ("Join", "Window", "RepartitionByExpression [file", "Sort "))


def test_pieces_are_found_as_by_the_pattern():
    draw = random.Random(9)
    for marks in ("aZ_9é½²ª·­ \x85\x1c\t.-", "aΣ日😀​“ é́.-"):
        for _ in range(300):
            text = "".join(draw.choice(marks) for _ in range(draw.randint(0, 30)))
            spans = [m.span() for m in chunking._PIECE.finditer(text)]
            assert chunking.count(text) == len(spans) and list(zip(*(x.tolist() for x in chunking.spots(text)), strict=True)) == spans
            longer = text.replace("a", "a" * draw.choice([1, 9, 50]))  # pieces may be cut where only the last characters are looked at
            begins = [m.start() for m in chunking._PIECE.finditer(longer)]
            assert [chunking.last_begin(longer, n + 1) for n in range(len(begins))] == begins[::-1]
