"""Sessions over events that arrive in batches, late ones included.

After each batch a user's events so far form sessions; a session that holds an
event of the batch is a new version and retracts the standing ones inside it.

The method is snapshot expansion: every event is replicated to the later
batches of its user, each (user, batch) is cut into islands by lagged gaps and
a cumulative sum, islands without an event of the batch go, and versions are
joined to their successors.  Copies are bounded: an event that is old enough
can be joined by no late one, so from then on it takes part in one row only,
the island that ends before the open span of time ("carried").  Carried islands
come from a prefix scan over blocks of time, so no window holds a whole user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Largest pause within a session and length of a batch, in seconds; batches that an event may come late.
GAP, BATCH_SECONDS, LATE = 420, 3600, 3
#: Blocks of time in a window of the scan, as a power of two, and how often blocks are gathered into larger ones.
SHIFT, LEVELS = 10, 2


def _tails(blocks: DataFrame, gap: int, shift: int, levels: int) -> DataFrame:
    """For each block of a user: ``tail``, the island that ends with the block, and ``before``, the one that ends before it.

    ``blocks`` (user, u, first, last, whole, tail): first and last event, whether
    the block is one island, and its last island (start, last, n, h) seen alone.
    """
    spark, part = blocks.sparkSession, f"user, shiftright(u, {shift})" if levels else "user"
    runs = spark.sql(
        f"""
        SELECT *, sum(IF(whole AND first - prev <= {gap}, 0, 1)) OVER (PARTITION BY {part} ORDER BY u) AS run
        FROM (SELECT *, lag(last) OVER (PARTITION BY {part} ORDER BY u) AS prev FROM {{blocks}})
        """,
        blocks=blocks,
    )
    # within the window: the tail gathers the blocks of its run; it is open if it reaches back to the window's first event
    inner = spark.sql(
        f"""
        SELECT user, u, first, last, run = 1 AND first_value(whole) OVER w AS open, first_value(first) OVER w AS head,
               named_struct('start', first_value(tail.start) OVER r, 'last', last, 'n', sum(tail.n) OVER r, 'h', sum(tail.h) OVER r) AS tail
        FROM {{runs}}
        WINDOW w AS (PARTITION BY {part} ORDER BY u), r AS (PARTITION BY {part}, run ORDER BY u)
        """,
        runs=runs,
    )
    if not levels:
        return spark.sql("SELECT user, u, tail, lag(tail) OVER (PARTITION BY user ORDER BY u) AS before FROM {inner}", inner=inner)
    parents = spark.sql(
        f"""
        SELECT user, shiftright(u, {shift}) AS u, min(first) AS first, max(last) AS last, max_by(open, u) AS whole, max_by(tail, u) AS tail
        FROM {{inner}} GROUP BY user, shiftright(u, {shift})
        """,
        inner=inner,
    )
    above = _tails(parents, gap, shift, levels - 1)
    return spark.sql(
        f"""
        SELECT user, u, tail, coalesce(lag(tail) OVER (PARTITION BY {part} ORDER BY u), carried) AS before
        FROM (
          SELECT i.user, i.u, a.before AS carried,
                 IF(i.open AND i.head - a.before.last <= {gap},
                    named_struct('start', a.before.start, 'last', i.last, 'n', a.before.n + i.tail.n, 'h', a.before.h + i.tail.h), i.tail) AS tail
          FROM {{inner}} i JOIN {{above}} a ON a.user = i.user AND a.u = shiftright(i.u, {shift})
        )
        """,
        inner=inner,
        above=above,
    )


def _versions(events: DataFrame, gap: int, batch_seconds: int, late: int | None, shift: int, levels: int) -> tuple[DataFrame, int]:
    spark = events.sparkSession
    unit = -(-gap // batch_seconds) * batch_seconds  # an island carried into a block ends in the block before
    m = unit // batch_seconds
    marks = spark.sql(
        f"""
        SELECT user, batch, s, CAST(floor(s / {unit}) AS BIGINT) AS u, count(*) AS n, sum(coalesce(h, 0L)) AS h
        FROM {{events}} WHERE user IS NOT NULL AND batch IS NOT NULL AND s IS NOT NULL GROUP BY user, batch, s
        """,
        events=events.select("user", "batch", "s", "h"),
    )
    marks = staged(marks, "marks")
    delay = f"batch - CAST(floor(s / {batch_seconds}) AS BIGINT)"
    if late is None:
        late = max(0, marks.agg(F.max(F.expr(delay))).first()[0] or 0)
    else:
        marks = marks.where(F.expr(f"IF({delay} > {late}, CAST(raise_error(concat('event of user ', user, ' comes too late: ', s)) AS BOOLEAN), true)"))
    blocks = spark.sql(
        f"""
        SELECT user, u, min(s) AS first, max(s) AS last, max(since) = min(s) AS whole,
               named_struct('start', max(since), 'last', max(s), 'n', sum(IF(s >= since, n, 0L)), 'h', sum(IF(s >= since, h, 0L))) AS tail
        FROM (
          SELECT *, max(IF(prev IS NULL OR s - prev > {gap}, s, NULL)) OVER (PARTITION BY user, u) AS since
          FROM (SELECT user, u, s, n, h, lag(s) OVER (PARTITION BY user, u ORDER BY s, batch) AS prev FROM {{marks}})
        ) GROUP BY user, u
        """,
        marks=marks,
    )
    found = spark.sql(
        f"""
        WITH snapshots AS (
          SELECT user, b, s AS first, s AS last, n, IF(batch = b, n, 0L) AS n_new, h
          FROM {{marks}} LATERAL VIEW explode(sequence(batch, {late} + (u + 1) * {m} - 1)) AS b
          UNION ALL
          SELECT user, b, tail.start, tail.last, tail.n, 0L, tail.h
          FROM {{tails}} LATERAL VIEW explode(sequence({late} + (u + 1) * {m}, {late} + (u + 2) * {m} - 1)) AS b
          WHERE (u + 1) * {unit} - tail.last <= {gap}
        ), cuts AS (
          SELECT *, IF(first - lag(last) OVER (PARTITION BY user, b ORDER BY first, last) <= {gap}, 0, 1) AS cut FROM snapshots
        ), islands AS (
          SELECT *, sum(cut) OVER (PARTITION BY user, b ORDER BY first, last) AS island FROM cuts
        )
        SELECT user, b AS batch, min(first) AS start_s, max(last) AS end_s, sum(n) AS n_events, sum(n_new) AS n_new, sum(h) AS h_sum
        FROM islands GROUP BY user, b, island HAVING sum(n_new) > 0
        """,
        marks=marks,
        tails=_tails(blocks, gap, shift, levels),
    )
    return found, late


def versions(events: DataFrame, gap: int = GAP, batch_seconds: int = BATCH_SECONDS, late: int | None = None, shift: int = SHIFT, levels: int = LEVELS) -> DataFrame:
    """Every session with an event of its batch: (user, batch, start_s, end_s, n_events, n_new, h_sum).

    ``events`` (user, batch, s, h).  ``late`` is how many batches after its own
    time an event may come; None measures it; an event later than that raises.
    Rows of null user, batch or s are no events, a null h counts 0, and repeated
    rows are events of their own.  An empty table gives no rows; other columns
    are not read.
    """
    return _versions(events, gap, batch_seconds, late, shift, levels)[0]


def merged(events: DataFrame, gap: int = GAP, batch_seconds: int = BATCH_SECONDS, late: int | None = None, shift: int = SHIFT, levels: int = LEVELS) -> DataFrame:
    """versions() with what each retracts and what retracts it.

    Adds n_retracted (standing sessions inside: 0 creation, 1 extension, more a
    merge), retracted_batch and retracted_start_s (the version that retracts
    this one; null while it stands).  What joins a session is within ``gap`` of
    it, so its successor is at most some batches away: versions are copied to
    these and joined on (user, batch) to the one that holds them.
    """
    spark = events.sparkSession
    found, late = _versions(events, gap, batch_seconds, late, shift, levels)
    held = staged(found, "versions")
    later = spark.sql(
        f"""
        SELECT v.user, v.batch, v.start_s, min(struct(w.batch AS batch, w.start_s AS start_s)) AS nxt
        FROM (
          SELECT user, batch, start_s, end_s, explode(sequence(batch + 1, upto)) AS b
          FROM (SELECT *, CAST(floor((end_s + {gap}) / {batch_seconds}) AS BIGINT) + {late} AS upto FROM {{held}}) WHERE upto > batch
        ) v JOIN {{held}} w ON w.user = v.user AND w.batch = v.b AND w.start_s <= v.start_s AND w.end_s >= v.end_s
        GROUP BY v.user, v.batch, v.start_s
        """,
        held=held,
    )
    later = staged(later, "successors")
    return spark.sql(
        """
        SELECT v.user, v.batch, v.start_s, v.end_s, v.n_events, v.n_new, coalesce(k.n_retracted, 0L) AS n_retracted, v.h_sum,
               l.nxt.batch AS retracted_batch, l.nxt.start_s AS retracted_start_s
        FROM {held} v
        LEFT JOIN {later} l ON l.user = v.user AND l.batch = v.batch AND l.start_s = v.start_s
        LEFT JOIN (SELECT user, nxt.batch AS batch, nxt.start_s AS start_s, count(*) AS n_retracted FROM {later} GROUP BY user, nxt.batch, nxt.start_s) k
          ON k.user = v.user AND k.batch = v.batch AND k.start_s = v.start_s
        """,
        held=held,
        later=later,
    )


def conversation_events(turns: DataFrame) -> DataFrame:
    """Events (user, batch, s, h) of conversation turns; a turn of null ``conv_id`` has no user and is no event."""
    return turns.sparkSession.sql(
        f"""
        SELECT user, CAST(floor(s / {BATCH_SECONDS}) AS BIGINT) + IF(g % 3 = 0, g % 4, 0) AS batch, s, h
        FROM (
          SELECT 2 * shiftright(conv_id, 3) + c % 2 AS user, shiftright(c, 1) % 7200 + 300 * turn + h % 600 AS s, h, h div 600 AS g
          FROM (
            SELECT conv_id, turn, crc32(CAST(CAST(conv_id AS STRING) AS BINARY)) AS c, crc32(CAST(concat(conv_id, ':', turn) AS BINARY)) AS h
            FROM (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn FROM {{turns}}) WHERE turn IS NOT NULL AND conv_id IS NOT NULL
          )
        )
        """,
        turns=turns.select("conv_id", "turn"),
    )


def conversation_sessions(turns: DataFrame) -> DataFrame:
    """Versions of the sessions of conversation turns; see merged() and conversation_events()."""
    return merged(conversation_events(turns), late=LATE)


#: The same rows by plain snapshots: all of a user's events so far at each of their batches.  CRC-32 is built from its polynomial.
SQL = """
WITH entries AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)
), turns AS (
  SELECT conv_id, turn, conv_id::VARCHAR AS a, conv_id::VARCHAR || ':' || turn::VARCHAR AS b
  FROM conversations WHERE turn IS NOT NULL AND conv_id IS NOT NULL
), sums AS (
  SELECT conv_id, turn,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(a, ''), lambda x: ascii(x)::BIGINT)), lambda p, q: xor(p >> 8, t[(xor(p, q) % 256 + 1)::INT]))) AS c,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(b, ''), lambda x: ascii(x)::BIGINT)), lambda p, q: xor(p >> 8, t[(xor(p, q) % 256 + 1)::INT]))) AS h
  FROM turns, entries
), timed AS (
  SELECT 2 * floor(conv_id / 8)::BIGINT + c % 2 AS user_id, (c // 2) % 7200 + 300 * turn + h % 600 AS s, h, h // 600 AS g FROM sums
), events AS (
  SELECT user_id, floor(s / 3600)::BIGINT + CASE WHEN g % 3 = 0 THEN g % 4 ELSE 0 END AS batch, s, h FROM timed
), snapshots AS (
  SELECT e.user_id, b.batch AS seen, e.batch, e.s, e.h FROM events e JOIN (SELECT DISTINCT user_id, batch FROM events) b ON b.user_id = e.user_id AND e.batch <= b.batch
), cuts AS (
  SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY user_id, seen ORDER BY s) <= 420 THEN 0 ELSE 1 END AS cut FROM snapshots
), islands AS (
  SELECT *, sum(cut) OVER (PARTITION BY user_id, seen ORDER BY s) AS island FROM cuts
), found AS (
  SELECT user_id, seen AS batch, min(s) AS start_s, max(s) AS end_s, count(*) AS n_events, count(*) FILTER (batch = seen) AS n_new, sum(h)::BIGINT AS h_sum
  FROM islands GROUP BY user_id, seen, island HAVING count(*) FILTER (batch = seen) > 0
), later AS (
  SELECT v.user_id, v.batch, v.start_s, w.batch AS nb, w.start_s AS ns
  FROM found v JOIN found w ON w.user_id = v.user_id AND w.batch > v.batch AND w.start_s <= v.start_s AND w.end_s >= v.end_s
  QUALIFY row_number() OVER (PARTITION BY v.user_id, v.batch, v.start_s ORDER BY w.batch) = 1
)
SELECT v.user_id AS "user", v.batch, v.start_s, v.end_s, v.n_events, v.n_new,
  (SELECT count(*) FROM later k WHERE k.user_id = v.user_id AND k.nb = v.batch AND k.ns = v.start_s) AS n_retracted,
  v.h_sum, l.nb AS retracted_batch, l.ns AS retracted_start_s
FROM found v LEFT JOIN later l ON l.user_id = v.user_id AND l.batch = v.batch AND l.start_s = v.start_s
"""
