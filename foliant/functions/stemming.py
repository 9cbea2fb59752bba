"""English stems by the published rules of the Porter2 (Snowball English) algorithm, over Arrow batches of word lists."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .batches import by_words

# The published lists and suffix rules of the algorithm, and the usual list of English stop words.
STOP_WORDS = """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having
do does did doing a an the and but if or because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where why how all any both each few more
most other some such no nor not only own same so than too very s t can will just don should now""".split()
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_PLURAL = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
R1_PREFIXES = ["gener", "commun", "arsen"]
DOUBLES = ["bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"]
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate",
    "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous",
    "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"]

_REGION = re.compile("[aeiouy][^aeiouy]")


def _longest(word: str, suffixes) -> str:
    """The longest of ``suffixes`` that ``word`` ends with, or nothing."""
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def _short_end(word: str) -> bool:
    """Whether a word ends in a short syllable."""
    return bool(re.search("[^aeiouy][aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$", word))


def _after(word: str, start: int) -> int:
    """Where the region begins behind the first vowel and consonant from ``start`` on."""
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


@lru_cache(maxsize=1 << 17)
def stem(word: str) -> str:
    """The stem of a lower-case word of ASCII letters; other words are their own stems."""
    if len(word) <= 2 or not re.fullmatch("[a-z]+", word):
        return word
    if word in WHOLE:
        return WHOLE[word]
    word = re.sub("([aeiouy])y", r"\1Y", re.sub("^y", "Y", word))
    prefix = next((p for p in R1_PREFIXES if word.startswith(p)), "")
    r1 = len(prefix) or _after(word, 0)
    r2 = _after(word, r1)

    ending = _longest(word, ["sses", "ied", "ies", "us", "ss", "s"])
    if ending == "sses":
        word = word[:-2]
    elif ending in ("ied", "ies"):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif ending == "s" and re.search("[aeiouy]", word[:-2]):
        word = word[:-1]
    if word in AFTER_PLURAL:
        return word

    ending = _longest(word, ["eed", "eedly", "ed", "edly", "ing", "ingly"])
    if ending in ("eed", "eedly"):
        word = word[: -len(ending)] + "ee" if len(word) - len(ending) >= r1 else word
    elif ending and re.search("[aeiouy]", word[: -len(ending)]):
        word = word[: -len(ending)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word[-2:] in DOUBLES:
            word = word[:-1]
        elif r1 >= len(word) and _short_end(word):
            word += "e"

    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"

    ending = _longest(word, STEP2)
    base = word[: len(word) - len(ending)]
    if ending and len(base) >= r1 and (ending != "ogi" or base.endswith("l")) and (ending != "li" or base[-1:] in tuple("cdeghkmnrt")):
        word = base + STEP2[ending]

    ending = _longest(word, STEP3)
    base = word[: len(word) - len(ending)]
    if ending and len(base) >= (r2 if ending == "ative" else r1):
        word = base + STEP3[ending]

    ending = _longest(word, STEP4)
    base = word[: len(word) - len(ending)]
    if ending and len(base) >= r2 and (ending != "ion" or base.endswith(("s", "t"))):
        word = base

    base = word[:-1]
    if word.endswith("e") and (len(base) >= r2 or (len(base) >= r1 and not _short_end(base))):
        word = base
    elif word.endswith("ll") and len(base) >= r2:
        word = base
    return word.replace("Y", "y")


def lexeme(word: str) -> str | None:
    """What is searched for a word: its stem; a stop word is searched as nothing."""
    return None if word in _STOP else stem(word)


_STOP = frozenset(STOP_WORDS)


def with_lexemes(rows: DataFrame, words: str = "words", name: str = "lexemes") -> DataFrame:
    """Add ``name``: the lexemes of the words in the array ``words``, place by place; null for a stop word.

    A batch's words are stemmed once each. A null list stays null.
    """

    def work(batches):
        for batch in (part for whole in batches for part in by_words(whole, words)):
            column = batch.column(words)
            coded = pc.dictionary_encode(column.flatten())
            known = pa.array([None if w is None else lexeme(w) for w in coded.dictionary.to_pylist()], pa.string())
            flat = known.take(coded.indices)
            lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
            made = pa.ListArray.from_arrays(offsets, flat, mask=column.is_null())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, name])

    return rows.mapInArrow(work, StructType([*rows.schema, StructField(name, ArrayType(StringType()))]))


def stem_sql(name: str, rows: str) -> str:
    """DuckDB steps that make ``name`` (word, lexeme) of the distinct words of ``rows`` (word): the same rules, by expressions over whole columns."""
    vowel, other = "[aeiouy]", "[^aeiouy]"
    alt = lambda xs: "|".join(sorted(xs, key=lambda x: (-len(x), x)))
    quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
    ends = lambda xs: f"regexp_extract(w, '({alt(xs)})$')"
    short = lambda c: f"regexp_matches({c}, '{other}{vowel}[^aeiouywxY]$|^{vowel}{other}$')"
    region = lambda c: f"CASE WHEN regexp_matches({c}, '{vowel}{other}') THEN length(regexp_extract({c}, '^.*?{vowel}{other}')) ELSE length({c}) END"
    base = "left(w, length(w) - length(s))"
    swap = lambda table: "CASE s " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"
    chosen = f"CASE {' '.join(f'''WHEN starts_with(w, '{p}') THEN {len(p)}''' for p in R1_PREFIXES)} ELSE {region('w')} END"
    done = "word, r1, r2, fin"
    return f"""{name}_0 AS (SELECT DISTINCT word, regexp_replace(regexp_replace(word, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w FROM {rows} WHERE word NOT IN ({quoted(STOP_WORDS)})),
  {name}_r AS (SELECT *, {chosen} AS r1 FROM {name}_0),
  {name}_i AS (SELECT *, r1 + {region("substr(w, r1 + 1)")} AS r2, CASE WHEN length(word) <= 2 OR NOT regexp_full_match(word, '[a-z]+') THEN word {" ".join(f"WHEN word = '{k}' THEN '{v}'" for k, v in WHOLE.items())} END AS fin FROM {name}_r),
  {name}_a AS (SELECT word, r1, r2, coalesce(fin, CASE WHEN w IN ({quoted(AFTER_PLURAL)}) THEN w END) AS fin, w FROM (SELECT {done}, CASE s WHEN 'sses' THEN left(w, length(w) - 2) WHEN 'ied' THEN left(w, length(w) - CASE WHEN length(w) > 4 THEN 2 ELSE 1 END) WHEN 'ies' THEN left(w, length(w) - CASE WHEN length(w) > 4 THEN 2 ELSE 1 END)
    WHEN 's' THEN CASE WHEN regexp_matches(left(w, length(w) - 2), '{vowel}') THEN left(w, length(w) - 1) ELSE w END ELSE w END AS w FROM (SELECT *, {ends(["sses", "ied", "ies", "us", "ss", "s"])} AS s FROM {name}_i))),
  {name}_b AS (SELECT {done}, CASE WHEN s IN ('eed', 'eedly') THEN CASE WHEN length({base}) >= r1 THEN {base} || 'ee' ELSE w END WHEN s <> '' AND regexp_matches({base}, '{vowel}') THEN {base} || '#' ELSE w END AS w FROM (SELECT *, {ends(["eed", "eedly", "ed", "edly", "ing", "ingly"])} AS s FROM {name}_a)),
  {name}_c AS (SELECT {done}, CASE WHEN NOT ends_with(w, '#') THEN w WHEN regexp_matches(w, '(at|bl|iz)#$') THEN replace(w, '#', 'e') WHEN regexp_matches(w, '({"|".join(DOUBLES)})#$') THEN left(w, length(w) - 2)
    WHEN r1 >= length(w) - 1 AND {short("left(w, length(w) - 1)")} THEN replace(w, '#', 'e') ELSE replace(w, '#', '') END AS w FROM {name}_b),
  {name}_y AS (SELECT {done}, CASE WHEN regexp_matches(w, '^.+{other}[yY]$') THEN left(w, length(w) - 1) || 'i' ELSE w END AS w FROM {name}_c),
  {name}_d AS (SELECT {done}, CASE WHEN s <> '' AND length({base}) >= r1 AND (s <> 'ogi' OR ends_with({base}, 'l')) AND (s <> 'li' OR regexp_matches({base}, '[cdeghkmnrt]$')) THEN {base} || {swap(STEP2)} ELSE w END AS w FROM (SELECT *, {ends(STEP2)} AS s FROM {name}_y)),
  {name}_e AS (SELECT {done}, CASE WHEN s <> '' AND length({base}) >= CASE WHEN s = 'ative' THEN r2 ELSE r1 END THEN {base} || {swap(STEP3)} ELSE w END AS w FROM (SELECT *, {ends(STEP3)} AS s FROM {name}_d)),
  {name}_f AS (SELECT {done}, CASE WHEN s <> '' AND length({base}) >= r2 AND (s <> 'ion' OR regexp_matches({base}, '[st]$')) THEN {base} ELSE w END AS w FROM (SELECT *, {ends(STEP4)} AS s FROM {name}_e)),
  {name} AS MATERIALIZED (SELECT word, coalesce(fin, replace(CASE WHEN ends_with(w, 'e') AND (length(w) - 1 >= r2 OR (length(w) - 1 >= r1 AND NOT {short("left(w, length(w) - 1)")})) THEN left(w, length(w) - 1)
    WHEN ends_with(w, 'll') AND length(w) - 1 >= r2 THEN left(w, length(w) - 1) ELSE w END, 'Y', 'y')) AS lexeme FROM {name}_f)"""
