"""Quality rules, line first: each line is judged, failing lines go, and documents that lose too much text are rejected.

Only built-in SQL functions, per row: no shuffle, so no key can become hot. A text's arrays live in one row.

A line with a word fails when one of these holds:
- punctuation: under MIN_LINE_WORDS words and no closing mark at its end; or over SYMBOL_SHARE per cent of its word
  characters are symbols; or over MARK_SHARE per cent of its words carry a doubled "!" or "?";
- navigation: three separators or more, and one for every NAV_WORDS words at least; or at most NAV_WORDS words that start
  like a menu entry;
- boilerplate: it has at most STOCK_WORDS words and holds a stock phrase, so a long line of prose may name a cookie.
Phrases are in the four languages of the corpus.

Defined cases: a null or empty text has all counts 0 and fails the base; lines without a word never fail and stay; rows
that repeat are judged alike; no rows give no rows; other columns are carried along by clean(). Repeated 3-word windows
are found by sorting 64-bit hashes and then compared word by word.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS, MAX_REPEAT = 50, 50
MIN_LINE_WORDS, NAV_WORDS, STOCK_WORDS, SYMBOL_SHARE, MARK_SHARE, MAX_LOST = 6, 8, 40, 20, 30, 40
SYMBOLS = "#*$%&|<>"
SYMBOL = "[#*$%&|<>]"
#: White space inside a line, but for the blank.
BLANKS = "\t\x0b\x0c\r"
CLOSED = r"[.!?:;,\"'”’»…)\]。！？][\x20\x09-\x0D]*$"
MENU = r"^[\x20\x09-\x0D]*(?i:home|menu|log ?in|sign ?(in|up)|next|previous|back to|contact|about us|share|search|skip to|read more|click here|startseite|anmelden|weiter|zurück|kontakt|accueil|connexion|suivant|précédent|inicio|siguiente|anterior|contacto)(?:[^A-Za-z]|$)"
SEPARATORS = r"[|»›>•·]"
# Stock phrases, in lower case: fixed values.
PHRASES = (
    "cookie", "privacy policy", "terms of use", "terms of service", "all rights reserved", "javascript", "subscribe", "newsletter", "lorem ipsum", "copyright (c)",
    "datenschutzerklärung", "alle rechte vorbehalten", "nutzungsbedingungen",
    "politique de confidentialité", "tous droits réservés", "conditions d'utilisation",
    "política de privacidad", "todos los derechos reservados", "términos de uso",
)
MARKS = r"!!|\?\?"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(line: Column) -> Column:
    """Words of one line."""
    for c in BLANKS:
        line = F.replace(line, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(line, " "), "")  # a split by one plain character needs no pattern


def symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SYMBOL)).cast("long")


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.

    A window is one number: its hash, cut to leave room below for its place. In sorted order equal windows are side by
    side; those of equal hash are compared word by word.
    """

    def runs(at: Column) -> Column:
        step = lambda i, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - i, F.lit(3)))
        return F.aggregate(F.transform(at, step), F.lit(0).cast("long"), lambda a, x: a + x)

    def twice(w: Column, s: Column, bits: Column) -> Column:
        at = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("int")

        def same(x: Column, y: Column) -> Column:
            i, j = at(x), at(y)
            return (F.call_function("shiftrightunsigned", x.bitwiseXOR(y), bits) == 0) & (F.get(w, i) == F.get(w, j)) & (F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2))

        found = F.filter(s, lambda x, k: F.coalesce(same(x, F.get(s, k + 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, k - 1)), F.lit(False)))
        return let(F.sort_array(F.transform(found, lambda x: at(x).cast("long"))), runs)

    def windows(w: Column, bits: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.call_function("shiftleft", F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), bits).bitwiseOR(i.cast("long")))
        return let(F.sort_array(each), lambda s: twice(w, s, bits))

    bits = lambda w: F.length(F.bin(F.size(w).cast("long")))
    return let(words, lambda w: F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(let(bits(w), lambda b: windows(w, b))))


def judged(line: Column) -> Column:
    """A struct of a line: its words, their number, characters and symbols, and whether it fails."""

    def whole(w: Column) -> Column:
        n, size, marks = F.size(w), F.length(F.array_join(w, "")).cast("long"), symbols(line)
        return let(F.struct(n.alias("n"), size.alias("size"), marks.alias("marks")), lambda x: F.struct(w.alias("w"), x["n"].alias("n"), x["size"].alias("size"), x["marks"].alias("marks"), fails(line, x["n"], x["size"], x["marks"]).alias("bad")))

    return let(words_of(line), whole)


def fails(line: Column, n: Column, size: Column, marks: Column) -> Column:
    loose = (n < MIN_LINE_WORDS) & ~line.rlike(CLOSED)
    noisy = 100 * marks > SYMBOL_SHARE * size
    shouted = 100 * F.regexp_count(line, F.lit(MARKS)) > MARK_SHARE * n
    menu = let(F.regexp_count(line, F.lit(SEPARATORS)), lambda k: (k >= 3) & (NAV_WORDS * k >= n)) | ((n <= NAV_WORDS) & line.rlike(MENU))
    stock = (n <= STOCK_WORDS) & let(F.lower(line), lambda x: reduce(lambda a, b: a | b, [x.contains(p) for p in PHRASES]))
    return (n > 0) & (loose | noisy | shouted | menu | stock)


def line_fails(line: Column) -> Column:
    return judged(line)["bad"]


def verdict(text: Column) -> Column:
    """A struct of the counts, the verdicts and the cleaned text. Every line is split into words once; what is counted of
    a text is the sum of its lines'."""
    text = F.coalesce(text, F.lit(""))

    def summed(ls: Column, lines: Column) -> Column:
        total = lambda c, x=None: F.aggregate(ls, F.lit(0).cast("long"), lambda a, v: a + (x(v) if x else v[c]))
        full = F.filter(lines, lambda v, k: F.get(ls, k)["n"] > 0)
        n_bad = total("", lambda v: v["bad"].cast("long"))
        return let(
            F.struct(
                F.flatten(F.transform(ls, lambda v: v["w"])).alias("w"), total("size").alias("c"), total("marks").alias("s"), n_bad.alias("bad"),
                total("", lambda v: F.when(v["bad"], v["size"]).otherwise(0)).alias("lost"),
                let(full, lambda f: (F.size(f) - F.size(F.array_distinct(f))).cast("long")).alias("dup"),
            ),
            lambda x: let(F.struct(F.size(x["w"]).cast("long").alias("n"), repeated_words(x["w"]).alias("rep")), lambda r: told(x, r, ls, lines)),
        )

    def told(x: Column, r: Column, ls: Column, lines: Column) -> Column:
        failed = (r["n"] < MIN_WORDS) | (100 * r["rep"] > MAX_REPEAT * r["n"])
        kept = ~failed & (100 * x["lost"] <= MAX_LOST * x["c"])
        clean = F.when(x["bad"] > 0, F.array_join(F.filter(lines, lambda v, k: ~F.get(ls, k)["bad"]), "\n")).otherwise(text)
        return F.struct(r["n"].alias("n_words"), x["c"].alias("word_chars"), x["s"].alias("n_symbols"), x["dup"].alias("n_dup_lines"), r["rep"].alias("n_repeat_words"), failed.alias("base_failed"), kept.alias("kept"), x["bad"].alias("n_failed_lines"), x["lost"].alias("lost_chars"), clean.alias("clean_text"))

    return let(F.split(text, "\n"), lambda lines: let(F.transform(lines, judged), lambda ls: summed(ls, lines)))


REPORT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_failed_lines", "lost_chars")


def report(docs: DataFrame) -> DataFrame:
    """doc_id with the counts and verdicts of every row."""
    judged = docs.select("doc_id", verdict(F.col("text")).alias("q"))
    return judged.select("doc_id", *[F.col(f"q.{c}") for c in REPORT])


def clean(docs: DataFrame) -> DataFrame:
    """The kept rows of docs with their failing lines gone; n_chars, where there is one, follows the text."""
    rows = docs.select(F.struct("*").alias("row"), verdict(F.col("text")).alias("q"))
    # explode, not a filter: a filter would be pushed below and evaluate the rules twice
    kept = rows.select("row", F.explode(F.filter(F.array("q"), lambda q: q["kept"])).alias("q"))
    new = {"text": F.col("q.clean_text"), "n_chars": F.length("q.clean_text").cast("long")}
    return kept.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])


_W = r"[^\x20\x09-\x0D]+"
_SOLID = "length(translate({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))"
_N = f"len(regexp_extract_all({{0}}, '{_W}'))"


def _q(s: str) -> str:
    return s.replace("'", "''")


#: The same by grouping: windows of words and lines as rows.
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
wl AS (SELECT r, regexp_extract_all(t, '{_W}') AS w FROM d),
ws AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM wl),
tri AS (SELECT r, i, word, lead(word, 1) OVER x AS w2, lead(word, 2) OVER x AS w3 FROM ws WINDOW x AS (PARTITION BY r ORDER BY i)),
cnt AS (SELECT r, i, w3 IS NOT NULL AND count(*) OVER (PARTITION BY r, word, w2, w3) >= 2 AS f FROM tri),
cov AS (SELECT r, i, f OR coalesce(lag(f, 1) OVER x, false) OR coalesce(lag(f, 2) OVER x, false) AS c FROM cnt WINDOW x AS (PARTITION BY r ORDER BY i)),
rep AS (SELECT r, count(*) AS n_words, count(*) FILTER (WHERE c) AS n_repeat_words FROM cov GROUP BY r),
ln AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
lf AS (SELECT r, line, {_SOLID.format("line")} AS s, {_N.format("line")} AS n FROM ln),
lj AS (SELECT r, line, s, n, n > 0 AND (
    (n < {MIN_LINE_WORDS} AND NOT regexp_matches(line, '{_q(CLOSED)}'))
    OR 100 * len(regexp_extract_all(line, '[{SYMBOLS}]')) > {SYMBOL_SHARE} * s
    OR 100 * len(regexp_extract_all(line, '{MARKS}')) > {MARK_SHARE} * n
    OR (len(regexp_extract_all(line, '{SEPARATORS}')) >= 3 AND {NAV_WORDS} * len(regexp_extract_all(line, '{SEPARATORS}')) >= n)
    OR (n <= {NAV_WORDS} AND regexp_matches(line, '{MENU}'))
    OR (n <= {STOCK_WORDS} AND ({" OR ".join(f"contains(lower(line), '{_q(p)}')" for p in PHRASES)}))) AS bad FROM lf),
la AS (SELECT r, count(*) FILTER (WHERE n > 0) - count(DISTINCT line) FILTER (WHERE n > 0) AS n_dup_lines, count(*) FILTER (WHERE bad) AS n_failed_lines, coalesce(sum(s) FILTER (WHERE bad), 0)::BIGINT AS lost_chars FROM lj GROUP BY r),
j AS (SELECT d.doc_id, coalesce(rep.n_words, 0) AS n_words, {_SOLID.format("t")}::BIGINT AS word_chars, len(regexp_extract_all(t, '[{SYMBOLS}]'))::BIGINT AS n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, n_failed_lines, lost_chars
    FROM d LEFT JOIN rep USING (r) LEFT JOIN la USING (r)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * lost_chars <= {MAX_LOST} * word_chars AS kept, n_failed_lines, lost_chars FROM b
"""
