"""Secrets: base spans by format, further spans by character Markov models.

Two first-order models over a 65-symbol alphabet, one of random strings and one
of ordinary identifiers, are trained from labelled samples generated by rule.
A candidate token is a secret when its log-likelihood ratio per character, in
integer thousandths, passes a threshold set on held-out samples.  Scoring is a
table look-up in DataFrame functions; no Python runs on the executors.
"""

from __future__ import annotations

import math
import random
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import let

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs shorter than the contract's least length are dropped by it, so they need not match here.
ACCESS, HEX = r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}"
#: Candidates of the method: long runs of the alphabet with a digit and a letter.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_"  # every other character is one more symbol
#: Labelled samples of either class that train the models, and of either class held out for the threshold.
TRAIN, HELD = 4000, 1000
#: Words of which the samples of ordinary identifiers are made.
WORDS = (
    "get set data value user name list item count index page file path read write load save open close start stop init build make find search sort"
    " merge update delete create insert remove parse format print string number array object class method function module package service client server request response"
    " session config option default context handler manager factory builder reader writer buffer stream thread worker queue stack table column field record key hash node tree"
    " graph edge path test error message event state type info detail total first last next current previous version license public private static final model view control"
    " the and that with from this have for not are was one all there when which their will each about how many then them these some would other into has more two time look people over"
).split()


#: Words of other languages, for the same.
OTHER_WORDS = (
    "benutzer datei ordner zeile anfang ende suche antwort anfrage fehler nummer straße liste konto kunde rechnung bestellung seite name adresse utilisateur fichier dossier ligne debut recherche reponse"
    " demande erreur numero compte client facture commande adresse usuario archivo carpeta linea inicio busqueda respuesta solicitud numero cuenta cliente factura pedido pagina direccion"
).split()


def samples(n: int, seed: str, secret: bool) -> list[str]:
    """Labelled samples: random strings of several alphabets; or identifiers, paths, slugs, numbered names, UUIDs and addresses."""
    rng, out = random.Random(seed), []
    for k in range(n):
        if secret:
            chars = (ALPHABET[:62], ALPHABET[:64], "0123456789abcdef", ALPHABET[:26] + "0123456789", ALPHABET[26:62])[k % 5]
            out.append("".join(rng.choice(chars) for _ in range(rng.randint(20, 48))))
            continue
        words = [rng.choice(WORDS if k % 4 else OTHER_WORDS) for _ in range(rng.randint(4, 8))]
        form, tail = k % 9, str(rng.randrange(10 ** rng.randint(0, 4))) if k % 3 == 0 else ""
        if form == 6:
            out.append("-".join("".join(rng.choice("0123456789abcdef") for _ in range(m)) for m in (8, 4, 4, 4, 12)))
        elif form == 7:
            out.append("/".join(w if rng.random() < 0.7 else str(rng.randrange(10_000)) for w in words) + f"/{rng.randrange(2000, 2030)}-{rng.randrange(10, 13)}-{rng.randrange(10, 29)}")
        elif form == 8:
            out.append("_".join(f"{w}{rng.randrange(100)}" for w in words))
        else:
            out.append(("_".join(words), "-".join(words), "".join(w.title() for w in words), words[0] + "".join(w.title() for w in words[1:]), "/".join(words), "_".join(words).upper())[form] + tail)
    return out


def _codes(s: str) -> list[int]:
    return [ALPHABET.find(c) % (len(ALPHABET) + 1) for c in s]


def _counts(texts: list[str]) -> list[float]:
    size = len(ALPHABET) + 1
    n = [0.5] * (size * size)
    for t in texts:
        c = _codes(t)
        for a, b in zip(c, c[1:], strict=False):
            n[a * size + b] += 1
    sums = [sum(n[a * size : (a + 1) * size]) for a in range(size)]
    return [n[k] / sums[k // size] for k in range(size * size)]


def ratio(s: str, table: list[int]) -> int:
    c, size = _codes(s), len(ALPHABET) + 1
    return sum(table[a * size + b] for a, b in zip(c, c[1:], strict=False))


@lru_cache(maxsize=2)
def trained(train: int = TRAIN, held: int = HELD) -> tuple[tuple[int, ...], int]:
    """(log-likelihood ratios in thousandths by symbol pair, least ratio per pair).

    The threshold keeps 99.8 % of the held-out identifiers out.
    """
    random_, plain = _counts(samples(train, "secret", True)), _counts(samples(train, "plain", False))
    table = [round(1000 * math.log(a / b)) for a, b in zip(random_, plain, strict=True)]
    scores = sorted(ratio(s, table) / (len(s) - 1) for s in samples(held, "plain held out", False))
    return tuple(table), max(0, math.ceil(scores[int(0.998 * held) - 1]) + 1)


# -- native spans ---------------------------------------------------------------


#: Elements that a scan folds at a time: arrays grow to this length, not to that of the whole.
SCAN = 64


def _scan(items: Column, zero: Column, step, emit, kind: str) -> Column:
    """emit(state, item) for each item in order, the state going from one to the next by step(state, item).

    In two levels: the state at the start of each block of SCAN items, then
    each block by itself.  One array that grows item by item would be copied
    each time.
    """
    start = F.struct(zero.alias("now"), F.array().cast("array<int>").alias("at"))
    none = F.array().cast(f"array<{kind}>")

    def dealt(own: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(own) - 1) / SCAN).cast("int"))), lambda i: F.slice(own, i * SCAN + 1, F.lit(SCAN)))

    def starts(blocks: Column) -> Column:
        return F.aggregate(blocks, start, lambda acc, b: F.struct(F.aggregate(b, acc["now"], step).alias("now"), F.concat(acc["at"], F.array(acc["now"])).alias("at")), lambda acc: acc["at"])

    def block(b: Column, now: Column) -> Column:
        return F.aggregate(b, F.struct(now.alias("now"), none.alias("out")), lambda acc, x: F.struct(step(acc["now"], x).alias("now"), F.concat(acc["out"], F.array(emit(acc["now"], x))).alias("out")), lambda acc: acc["out"])

    return let(items, lambda own: let(dealt(own), lambda blocks: F.flatten(F.zip_with(blocks, starts(blocks), block))))


_SPAN = "struct<s:int,k:int,e:int,kind:string,h:string>"


def _spans(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """All leftmost non-overlapping matches as (start, rank of kind, end, kind, matched text), by position.

    The texts between matches (split) and the matches (extract all) alternate,
    so running lengths give the positions in code points.
    """
    gaps, hits = F.transform(F.split(text, pattern, -1), F.length), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = let(hits, lambda own: F.zip_with(F.slice(gaps, F.lit(1), F.size(own)), own, lambda g, h: F.struct(g.alias("g"), h.alias("h"))))
    empty = F.array().cast(f"array<{_SPAN}>")

    def emit(at: Column, p: Column) -> Column:
        start = at + p["g"]
        return F.struct(start.alias("s"), F.lit(KINDS.index(kind)).alias("k"), (start + F.length(p["h"])).alias("e"), F.lit(kind).alias("kind"), p["h"].alias("h"))

    found = _scan(pairs, F.lit(0), lambda at, p: at + p["g"] + F.length(p["h"]), emit, _SPAN)
    found = F.filter(found, keep) if keep else found
    return F.when(F.regexp(text, F.lit(pattern)), found).otherwise(empty)


def _apart(tokens: Column, base: Column) -> Column:
    """The tokens that overlap no base span: all are gone through by position, once from either end."""
    last = F.lit((1 << 31) - 1)
    is_token = lambda x: x["k"] == len(KINDS) - 1
    flag = lambda x, hit: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["kind"].alias("kind"), F.when(is_token(x) & hit, F.lit(None)).otherwise(x["h"]).alias("h"))
    ordered = F.sort_array(F.concat(tokens, base))
    forth = _scan(ordered, F.lit(0), lambda end, x: F.when(is_token(x), end).otherwise(F.greatest(end, x["e"])), lambda end, x: flag(x, x["s"] < end), _SPAN)
    back = _scan(F.reverse(forth), last, lambda start, x: F.when(is_token(x), start).otherwise(x["s"]), lambda start, x: flag(x, x["e"] > start), _SPAN)
    return F.when((F.size(tokens) == 0) | (F.size(base) == 0), tokens).otherwise(F.sort_array(F.filter(back, lambda x: is_token(x) & x["h"].isNotNull())))


def _ratio_per_pair(s: Column) -> Column:
    """Whether the log-likelihood ratio of ``s``, whole thousandths, reaches the threshold times its pairs."""
    table, least = trained()
    size = len(ALPHABET) + 1
    values = F.array(*[F.lit(v) for v in table])
    code = lambda c: F.pmod(F.position(c, F.lit(ALPHABET)) - 1, F.lit(size))
    codes = F.transform(F.split(s, ""), code)
    start = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("sum"))
    total = F.aggregate(
        codes,
        start,
        lambda acc, c: F.struct(c.alias("last"), (acc["sum"] + F.when(acc["last"] < 0, F.lit(0)).otherwise(F.get(values, acc["last"] * size + c))).alias("sum")),
        lambda acc: acc["sum"],
    )
    return total >= F.lit(least) * (F.length(s) - 1)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_assign, n_access, n_hex, base_sha256, spans, n_markov) for each row.

    Counts and base_sha256 are of the base spans; ``spans`` lists these and the
    method's, which overlap no base span; positions in code points, end
    exclusive.  A null text counts as empty: no spans, digest of the empty
    string.  Rows are independent: repeated ids and rows stay; other columns are
    not read; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    df = df.withColumns(
        {
            "assign": _spans(F.col("text"), ASSIGN, "assign", lambda x: F.length(F.regexp_extract(x["h"], ASSIGN, 1)) >= 8),
            "access": _spans(F.col("text"), ACCESS, "access"),
            "hex": _spans(F.col("text"), HEX, "hex"),
            "tokens": _spans(F.col("text"), CANDIDATE, "markov", lambda x: x["h"].rlike("[0-9]") & x["h"].rlike("[A-Za-z]")),
        }
    )
    df = df.withColumn("base", F.concat("assign", "access", "hex"))
    df = df.withColumn("apart", _apart(F.col("tokens"), F.col("base"))).withColumn("markov", F.filter("apart", lambda x: _ratio_per_pair(x["h"])))
    return df.select(
        F.col("id").alias(id_col),
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.concat("base", "markov")).alias("spans"),
        F.size("markov").cast("long").alias("n_markov"),
    )


def sql() -> str:
    """The same in SQL, with the trained table as a literal list."""
    table, least = trained()
    size = len(ALPHABET) + 1
    q = lambda p: "'" + p.replace("'", "''") + "'"

    def spans(name: str, pattern: str, kind: str, where: str) -> str:
        return f"""
{name}_h AS (SELECT r, t, regexp_extract_all(t, {q(pattern)}) AS hs FROM d WHERE regexp_matches(t, {q(pattern)})),
{name}_g AS (SELECT r, unnest(hs) AS h, unnest(range(1, len(hs) + 1)) AS i, unnest(list_slice(list_transform(regexp_split_to_array(t, {q(pattern.replace("([A-Za-z0-9+/_.=-]+)", "[A-Za-z0-9+/_.=-]+"))}), lambda x: length(x)), 1, len(hs))) AS g FROM {name}_h),
{name}_s AS (SELECT r, h, {KINDS.index(kind)} AS k, '{kind}' AS kind, sum(g + length(h)) OVER w - length(h) AS s, sum(g + length(h)) OVER w AS e FROM {name}_g WINDOW w AS (PARTITION BY r ORDER BY i)),
{name} AS (SELECT * FROM {name}_s WHERE {where})"""

    listed = "string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, k, e)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),{spans("a", ASSIGN, "assign", f"length(regexp_extract(h, {q(ASSIGN)}, 1)) >= 8")},{spans("b", ACCESS, "access", "true")},{spans("c", HEX, "hex", "true")},{spans("m", CANDIDATE, "markov", "regexp_matches(h, '[0-9]') AND regexp_matches(h, '[A-Za-z]')")},
base AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c),
apart AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.r = m.r AND m.s < base.e AND base.s < m.e)),
pairs AS (SELECT r, s, e, unnest(range(1, length(h))) AS i, h FROM apart),
codes AS (SELECT r, s, e, length(h) - 1 AS n, (strpos('{ALPHABET}', substr(h, i, 1)) + {size - 1}) % {size} AS a, (strpos('{ALPHABET}', substr(h, i + 1, 1)) + {size - 1}) % {size} AS b FROM pairs),
scored AS (SELECT r, s, e FROM codes GROUP BY r, s, e, n HAVING sum(list_extract({list(table)}, CAST(a * {size} + b + 1 AS BIGINT))) >= {least} * n),
markov AS (SELECT m.* FROM m JOIN scored USING (r, s, e)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM markov),
bs AS (SELECT r, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2, {listed} AS l FROM base GROUP BY r),
es AS (SELECT r, count(*) FILTER (k = 3) AS n3, {listed} AS l FROM every GROUP BY r)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(bs.l, '')) AS base_sha256, coalesce(es.l, '') AS spans, coalesce(n3, 0) AS n_markov
FROM d LEFT JOIN bs USING (r) LEFT JOIN es USING (r)
"""
