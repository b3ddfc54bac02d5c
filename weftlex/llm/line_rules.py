"""Quality rules, line first, in DataFrame functions only.

Each line is judged by itself (punctuation, navigation, boilerplate, symbols,
shouting); failing lines are removed; a document that loses too much of its
text is rejected.  The contract's base statistics are taken of the whole text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that separate words, as a regular expression.
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Base rules: fewest words; most words in repeated windows, in percent.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: A document is rejected that loses more than this share of its characters, in percent.
MOST_LOST = 50
#: A line fails with more than this share of symbols or of capitals, in percent.
MOST_SYMBOLS, MOST_CAPITALS = 7, 50
#: A line this short fails unless it ends in punctuation; shorter than SHOUT a line may be all capitals.
SHORT, SHOUT = 15, 20
LETTER = r"\p{L}"
CAPITAL = r"\p{Lu}"
TERMINAL = r"[.!?…:;,)\]}\x22\x27”’»0-9。！？；：）」』؟۔।॥]\s*$"
#: A line of which links hold more than half of the characters, or separators stand between few words, is navigation.
LINK = r"(?:https?://|www\.)[^\x20\x09-\x0D]+"
SEPARATOR = r"[|›»•·→←]"
WORDS = r"[^\x20\x09-\x0D]+"
# What navigation and boilerplate say in English, German, French and Spanish.
NAVIGATION = (
    r"(?i)^\s*(home|menu|log ?in|sign (up|in)|next|previous|back to top|skip to content|share this|read more"
    r"|startseite|men[uü]|anmelden|registrieren|weiter|zurück|nach oben|teilen|mehr lesen|weiterlesen"
    r"|accueil|connexion|s'inscrire|suivant|précédent|haut de page|partager|lire la suite"
    r"|inicio|menú|iniciar sesión|registrarse|siguiente|anterior|volver arriba|compartir|leer más)\s*[.!»›>]*\s*$"
)
BOILERPLATE = (
    r"(?i)all rights reserved|cookie (policy|settings|preferences)|accept (all )?cookies|terms of (use|service)|privacy policy|enable javascript|subscribe to our newsletter"
    r"|alle rechte vorbehalten|cookie-(einstellungen|richtlinie)|cookies (akzeptieren|ablehnen)|nutzungsbedingungen|datenschutzerkl(ä|ae)rung|newsletter abonnieren"
    r"|tous droits réservés|politique de (cookies|confidentialité)|accepter (tous )?les cookies|conditions (générales )?d'utilisation|abonnez-vous à notre"
    r"|todos los derechos reservados|política de (cookies|privacidad)|aceptar (todas )?las cookies|términos (de uso|y condiciones)|suscríbete a nuestro"
)


def line_fails(line: Column) -> Column:
    """Whether a line that has a word is removed."""
    n = F.length(line)
    # plain searches come first: most lines have neither a link nor a separator
    has = lambda *parts: reduce(lambda a, b: a | b, (F.contains(line, F.lit(p)) for p in parts))
    return (
        ~line.rlike(LETTER)
        | ((n <= F.lit(SHORT)) & ~line.rlike(TERMINAL))
        | ((n <= F.lit(60)) & line.rlike(NAVIGATION))
        | (has("http", "www.") & line.rlike(LINK) & (F.length(F.regexp_replace(line, F.lit(LINK), F.lit(""))) * 2 < n))
        | (has(*SEPARATOR[1:-1]) & (F.regexp_count(line, F.lit(SEPARATOR)) >= 2) & (F.regexp_count(line, F.lit(SEPARATOR)) * 4 >= F.regexp_count(line, F.lit(WORDS))))
        | (F.regexp_count(line, F.lit(SYMBOLS)) * 100 > n * MOST_SYMBOLS)
        | ((n >= F.lit(SHOUT)) & (F.regexp_count(line, F.lit(CAPITAL)) * 100 > n * MOST_CAPITALS))
        | line.rlike(BOILERPLATE)
    )


def _with_repeats(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words from ``words``: words in 3-word windows that are found twice or more.

    Windows are hashed; where some hash repeats, (hash, position) pairs are
    sorted, those equal to a neighbour give the repeated positions, and each of
    these adds the words that the one before it did not cover.
    """
    n = F.size("words")
    second = F.zip_with(F.slice("words", F.lit(1), n - 2), F.slice("words", F.lit(2), n - 2), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    keys = F.zip_with(second, F.slice("words", F.lit(3), n - 2), lambda s, c: F.xxhash64(s["a"], s["b"], c))
    df = df.withColumn("keys", F.when(n >= 3, keys))
    own = F.sort_array(F.zip_with("keys", F.sequence(F.lit(0), F.size("keys") - 1), lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    df = df.withColumn("own", F.when(F.size(F.array_distinct("keys")) < F.size("keys"), own))
    m = F.size("own")
    none = F.array(F.lit(None).cast("struct<k:bigint,i:int>"))
    same = F.zip_with("own", F.concat(none, F.slice("own", F.lit(1), m - 1)), lambda a, b: F.struct(a["k"].alias("k"), a["i"].alias("i"), F.coalesce(a["k"] == b["k"], F.lit(False)).alias("d")))
    same = F.zip_with(same, F.concat(F.slice("own", F.lit(2), m - 1), none), lambda a, b: F.when(a["d"] | F.coalesce(a["k"] == b["k"], F.lit(False)), a["i"]))
    df = df.withColumn("at", F.when(F.col("own").isNotNull(), F.sort_array(F.filter(same, lambda i: i.isNotNull()))))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate("at", start, lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")), lambda acc: acc["n"])
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("keys", "own", "at")


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lost_lines[, clean_text]).

    ``kept`` is false if the base rules fail, or if the lines removed hold more
    than MOST_LOST percent of the characters in lines that have words.  A null
    or empty text has no words, so it fails.  Rows are independent: repeated
    ids and rows stay; other columns are not read; an empty table gives no rows.
    ``clean_text``: the lines that stay, in order.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    df = df.withColumn("words", F.filter(F.split("text", SPACES), lambda w: w != ""))
    df = df.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = _with_repeats(df)
    df = df.withColumn("judged", F.transform("lines", lambda x: F.struct(F.length(x).alias("n"), line_fails(x).alias("bad"))))
    total = F.aggregate("judged", F.lit(0), lambda acc, x: acc + x["n"])
    lost = F.aggregate("judged", F.lit(0), lambda acc, x: acc + F.when(x["bad"], x["n"]).otherwise(F.lit(0)))
    df = df.select(
        "id",
        "text",
        "lines",
        "judged",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        total.alias("total"),
        lost.alias("lost"),
        F.size(F.filter("judged", lambda x: x["bad"])).cast("long").alias("n_lost_lines"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    df = df.withColumn("base_failed", failed).withColumn("kept", ~failed & (100 * F.col("lost").cast("long") <= MOST_LOST * F.col("total").cast("long")))
    out = [F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost_lines"]
    if with_text:
        clean = F.array_join(F.transform(F.filter(F.arrays_zip("lines", "judged"), lambda z: ~z["judged"]["bad"]), lambda z: z["lines"]), "\n")
        out.append(clean.alias("clean_text"))
    return df.select(*out)


def _sql_pattern(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(t, {_sql_pattern(SPACES)}), lambda x: x <> '') AS ws FROM d),
k AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM k),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM c WHERE n > 1) GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d),
g AS (SELECT r, count(*) - count(DISTINCT l) AS dup, sum(length(l)) AS total, sum(CASE WHEN bad THEN length(l) ELSE 0 END) AS lost, count(*) FILTER (bad) AS nbad FROM (
  SELECT r, l, (NOT regexp_matches(l, {_sql_pattern(LETTER)}))
    OR (length(l) <= {SHORT} AND NOT regexp_matches(l, {_sql_pattern(TERMINAL)}))
    OR (length(l) <= 60 AND regexp_matches(l, {_sql_pattern(NAVIGATION)}))
    OR (regexp_matches(l, {_sql_pattern(LINK)}) AND length(regexp_replace(l, {_sql_pattern(LINK)}, '', 'g')) * 2 < length(l))
    OR (len(regexp_extract_all(l, {_sql_pattern(SEPARATOR)})) >= 2 AND len(regexp_extract_all(l, {_sql_pattern(SEPARATOR)})) * 4 >= len(regexp_extract_all(l, {_sql_pattern(WORDS)})))
    OR len(regexp_extract_all(l, {_sql_pattern(SYMBOLS)})) * 100 > length(l) * {MOST_SYMBOLS}
    OR (length(l) >= {SHOUT} AND len(regexp_extract_all(l, {_sql_pattern(CAPITAL)})) * 100 > length(l) * {MOST_CAPITALS})
    OR regexp_matches(l, {_sql_pattern(BOILERPLATE)}) AS bad
  FROM l WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]')) GROUP BY r),
s AS (SELECT d.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(length(array_to_string(w.ws, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(d.t, {_sql_pattern(SYMBOLS)})) AS BIGINT) AS n_symbols, CAST(coalesce(g.dup, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(g.total, 0) AS total, coalesce(g.lost, 0) AS lost, CAST(coalesce(g.nbad, 0) AS BIGINT) AS n_lost_lines
  FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN g USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AS base_failed,
  (NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND 100 * lost <= {MOST_LOST} * total) AS kept, n_lost_lines
FROM s
"""
