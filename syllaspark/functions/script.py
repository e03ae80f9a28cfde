"""Column functions on syllabic-script text: normalising, splitting, consonant-vowel (CV) form and back."""

from __future__ import annotations

import functools
import re
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space, punctuation and affix lists that give the same results as the original tokenizer.
WS = r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
KEPT = r"\x{1200}-\x{139F}\x{2D80}-\x{2DDF}0-9" + WS + r"\-.,:?!\x{FEFF}"
VOWELS = ["አ", "ኡ", "ኢ", "ኣ", "ኤ", "እ", "ኦ", "ኡኣ"]
ROWS = "ሀለሐመሠረሰሸቀበቨተቸኀነኘከኸወዐዘዠየደጀገጠጨጰጸፀፈፐ"
LABIALISED = {"ቀ": "ቋ", "ኀ": "ኋ", "ከ": "ኳ", "ኸ": "ዃ"}
MORPH_SUFFIXES = "ዎቹን ዎቹ ኦች ዎች ዋን ቱን ቱ ዋ ች ን ም ስ ና ሽ ሁ ው".split()
MORPH_PREFIXES = "እስከ እንደ ወደ ስለ ያል አል የ ለ በ ከ ብ".split()
HYBRID_SUFFIXES = "ዎቹን ዎቹ ኦች ዎች ዋን ቱን ቱ ዋ ች ን".split()
HYBRID_PREFIXES = "እንደ እስከ ወደ ስለ የ ለ በ ከ".split()
PUNCTUATION = list(".,;:!?\"'()[]{}") + list("+-*/=<>%&|^~`") + list("$€£¥¢@#§©®™") + [", ", "–", "—", "…"]
SYMBOLS = list("°±×÷√∞∑∏∫∆∇") + list("←→↑↓↔↕↖↗↘↙") + list("αβγδεζηθικλμνξοπρστυφχψω") + list("ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ") + list("0123456789")
BLOCKS = [(0x1200, 0x1380), (0x1380, 0x13A0), (0x2D80, 0x2DE0), (0x2000, 0x2070), (0x2E00, 0x2E80), (0x20A0, 0x20D0), (0x2200, 0x2300), (0x2600, 0x2700)]
NAME_VOWELS = ["AA", "EE", "IH", "A", "U", "I", "E", "O", "Ä"]
UNK, PAD = "<unk>", "<pad>"


@functools.cache
def fidel_pairs() -> list[tuple[str, str]]:
    """(glyph, CV form) of the 271 mapped syllables: a row's base gives its consonant (the sixth order) and the column the vowel."""
    out = [(v, v) for v in map(chr, range(0x12A0, 0x12A8))]
    for base in ROWS:
        consonant = chr(ord(base) + 5)
        for k, vowel in enumerate(VOWELS):
            glyph = LABIALISED.get(base, chr(ord(base) + 7)) if k == 7 else chr(ord(base) + k)
            if not (base == "ዐ" and k == 7):
                out.append((glyph, consonant + vowel))
    return out


CONSONANTS = "".join(chr(ord(b) + 5) for b in ROWS)
CV_UNIT = f"(?s)([{CONSONANTS.replace('ዕ', '')}]ኡኣ|[{CONSONANTS}][አኡኢኣእኤኦ]|.)"
#: The deterministic transliteration that gives the Latin test documents syllabic text.
LATIN, GLYPHS = "abcdefghijklmnopqrstuvwxyz", "ቱበከርኣፈገደእጆኳለመንዎጵቋየችወቹቨዋጸይዘ"
WORD = rf"([-.,:?!፡።፣]|[^-{WS}.,:?!፡።፣]+)"
SEPARATED = rf"([{WS}.,;:!?።፡፤፣]|[^{WS}.,;:!?።፡፤፣]+)"


def transliterate(text: Column) -> Column:
    return F.translate(F.lower(text), LATIN, GLYPHS)


def normalise(text: Column) -> Column:
    """Foreign runs become a space; in runs without Latin letters and CJK characters, other digits are kept, one by one.

    A run is looked at from its beginning only and never given back, so the time is linear in the text; texts without
    Latin letters and CJK characters, which have no such run, are passed over.
    """
    latin_cjk = r"A-Za-z\x{4E00}-\x{9FFF}"
    other = f"[^{KEPT}{latin_cjk}]"
    text = F.when(text.rlike(f"[{latin_cjk}]"), F.regexp_replace(text, rf"(?<!{other}){other}*+[{latin_cjk}][^{KEPT}]*+", " ")).otherwise(text)
    text = F.regexp_replace(text, r"([^\P{Nd}0-9])", " $1 ")
    return F.regexp_replace(text, rf"[^{KEPT}\p{{Nd}}]+", " ")


def split_words(text: Column) -> Column:
    """Words and punctuation marks, each mark by itself. White space of all kinds is made plain first, as wide character classes are slow."""
    apart = F.regexp_replace(plain_space(text, " "), "([-.,:?!፡-፣])", " $1 ")
    return F.array_remove(F.split(apart, " +"), "")


def plain_space(text: Column, mark: str, but: str = "") -> Column:
    """text with each white space character (not those in `but`) as `mark`, at the same places."""
    own = "".join(c for c in _white_space() if c not in but)
    return F.translate(text, own, mark * len(own))


@functools.cache
def _white_space() -> str:
    return "".join(chr(c) for c in range(0x3001) if re.match(f"[{re.sub(r'.x.(\w+).', lambda m: chr(int(m[1], 16)), WS)}]", chr(c)))


def decompose(text: Column, pairs: dict[str, str] | None = None) -> Column:
    """CV form. A glyph's first character and the rest of its form come from two translations, which look characters up by hash; a map would be searched from end to end for every character."""
    own = {g: cv for g, cv in (pairs.items() if pairs else fidel_pairs()) if g != cv}
    rests = sorted({cv[1:] for cv in own.values()})
    mark = {r: chr(0xE000 + k) for k, r in enumerate(rests)}
    first = F.translate(text, "".join(own), "".join(cv[0] for cv in own.values()))
    rest = F.translate(text, "".join(own), "".join(mark[cv[1:]] for cv in own.values()))

    def joined(a: Column, b: Column) -> Column:
        out = F.when(a == b, a)  # neither was translated
        for r in rests:
            out = out.when(b == mark[r], F.concat(a, F.lit(r)))
        return out.otherwise(a)

    return F.array_join(F.zip_with(F.split(first, ""), F.split(rest, ""), joined), "")


def recompose(cv: Column) -> Column:
    """Glyphs of a CV form: each unit's consonant is translated to the column of its vowel."""
    columns = {v: [(c, g) for g, x in fidel_pairs() for c, r in [(x[0], x[1:])] if r == v] for v in VOWELS}

    def glyph(unit: Column) -> Column:
        vowel, consonant = F.substring(unit, 2, 2), F.substring(unit, 1, 1)
        out = F.when(vowel == "", unit)
        for v, own in columns.items():
            out = out.when(vowel == v, F.translate(consonant, "".join(c for c, _ in own), "".join(g for _, g in own)))
        return out.otherwise(unit)

    return F.array_join(F.transform(F.regexp_extract_all(cv, F.lit(CV_UNIT), F.lit(1)), glyph), "")


def word_mapping(word: Column) -> Column:
    """{word: its CV form}."""
    return F.create_map(word, decompose(word))


@functools.cache
def _tables() -> tuple[dict[str, str], dict[str, str]]:
    return dict(fidel_pairs()), {v: k for k, v in fidel_pairs()}


def decompose_py(text: str) -> str:
    table = _tables()[0]
    return "".join(table.get(c, c) for c in text)


def recompose_py(cv: str) -> str:
    table = _tables()[1]
    return "".join(table.get(x, x) for x in re.findall(CV_UNIT, cv))


def is_ethiopic(token: Column) -> Column:
    return token.rlike(r"^[\x{1200}-\x{137F}]+$")


def not_blank(token: Column) -> Column:
    return token.rlike(f"[^{WS}]")


def composite_id(base: Column, spaced: Column, n_ids: Column) -> Column:
    """Id that also tells whether a space comes first. n_ids: ids of the vocabulary, specials included."""
    return n_ids * 2 + 1 + base * 2 + spaced.cast("long")


def custom_tokens() -> list[str]:
    """Single characters (and the two-character ', ') that every raw-script vocabulary has."""
    return sorted({*PUNCTUATION, *SYMBOLS, *(chr(c) for a, b in BLOCKS for c in range(a, b))})


def fidel_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fidel_pairs(), "glyph string, cv string")


def cv_keys(spark: SparkSession) -> DataFrame:
    """glyph, consonant, vowel of the named syllables of the three blocks; a consonant and vowel that several glyphs share get the code point added."""
    rows = [(chr(c), n) for a, b in BLOCKS[:3] for c in range(a, b) if "ETHIOPIC SYLLABLE" in (n := unicodedata.name(chr(c), ""))]
    names = spark.createDataFrame(rows, "glyph string, name string").withColumn("last", F.substring_index("name", " ", -1))
    ends = [F.when(F.col("last").endswith(v), F.lit(v)) for v in NAME_VOWELS]
    names = names.withColumn("v", F.coalesce(*ends, F.expr("right(last, 1)"))).withColumn("c", F.expr("left(last, length(last) - length(v))"))
    empty = F.col("c") == ""
    named = names.select("glyph", F.when(empty, F.col("last")).otherwise(F.col("c")).alias("c"), F.when(empty, F.lit("A")).otherwise(F.col("v")).alias("v"))
    shared = named.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    code = F.concat(F.lit("_"), F.lpad(F.hex(F.ascii("glyph")), 4, "0"))
    return named.join(shared, ["c", "v"]).select("glyph", F.concat(F.lit("C_"), "c", F.when(F.col("n") > 1, code).otherwise(F.lit(""))).alias("consonant"), F.concat(F.lit("V_"), "v").alias("vowel"))


def register(spark: SparkSession) -> None:
    """SQL functions syl_transliterate, syl_words: temporary functions that Catalyst inlines."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION syl_transliterate(t STRING) RETURNS STRING RETURN translate(lower(t), '{LATIN}', '{GLYPHS}')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION syl_words(t STRING) RETURNS ARRAY<STRING> RETURN regexp_extract_all(t, r'" + WORD + "', 1)")
