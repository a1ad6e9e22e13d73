"""Repair of conversation structure: the cheapest edits that make turns follow ``(s?(ua)+)?``.

Rows are kept, re-roled, deleted, and empty ones inserted. A row moves between
four states (nothing yet, after system, after user, after assistant). Forward
cost vectors over the first half of a conversation and backward ones over the
second meet in the middle; the optimal crossing whose edits are least in ASCII
splits the conversation into two that are solved in the same way, so memory is
linear in the number of rows, at a byte or two each.

Faults come from joins and aggregates over hashes of rows, edits from a pass
over one small record a row, and the texts are read in order once, with the
edits before them, without a conversation ever being whole in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinweave.plans.scratch import Scratch

SPACES = " \t\n\x0b\f\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
_FINE, _CUT, _BLANK, _COPY = range(4)
_INITIALS = "sua"
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
_WANTED = ("user", "user", "assistant", "user")
_AFTER_WANTED = (2, 2, 3, 2)
_AFTER_KEPT = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {})
#: What is left to insert when the rows are over.
_TAIL = ("", "II", "I", "")
_END = tuple(INSERT * len(x) for x in _TAIL)
_NEVER = 1 << 60


def _moves(initial: int, fault: int) -> tuple:
    """For each state, the ways over one row: {state after it: (cost, edits)}, insertions before it included."""
    table = []
    for state in range(4):
        best: dict[int, tuple[int, str]] = {}
        at, cost, edits = state, 0, ""
        for _ in range(3):
            ways = [(at, DELETE, "D")]
            if fault in (_FINE, _CUT):
                extra = TRUNCATED if fault == _CUT else 0
                ways.append((_AFTER_WANTED[at], REROLE + extra, "R"))
                if at in _AFTER_KEPT[initial]:
                    ways.append((_AFTER_KEPT[initial][at], KEEP + extra, "K"))
            for to, more, edit in ways:
                best[to] = min(best.get(to, (_NEVER, "")), (cost + more, edits + edit))
            at, cost, edits = _AFTER_WANTED[at], cost + INSERT, edits + "I"
        table.append(best)
    return tuple(table)


_MOVES = tuple(_moves(code >> 2, code & 3) for code in range(16))
_STEPS = tuple(tuple((s, t, c) for s, ways in enumerate(table) for t, (c, _) in ways.items()) for table in _MOVES)


def _forward(codes: bytes, lo: int, hi: int, state: int) -> list[int]:
    """Cost of each state after rows lo..hi-1, beginning in ``state``."""
    costs = [_NEVER] * 4
    costs[state] = 0
    for k in range(lo, hi):
        after = [_NEVER] * 4
        for s, t, c in _STEPS[codes[k]]:
            c += costs[s]
            if c < after[t]:
                after[t] = c
        costs = after
    return costs


def _backward(codes: bytes, lo: int, hi: int, ends: list[int]) -> list[int]:
    """Cost of ending well from each state before rows lo..hi-1."""
    for k in range(hi - 1, lo - 1, -1):
        before = [_NEVER] * 4
        for s, t, c in _STEPS[codes[k]]:
            c += ends[t]
            if c < before[s]:
                before[s] = c
        ends = before
    return ends


def _least_crossing(codes: bytes, lo: int, mid: int, state: int, ends: list[int]) -> int:
    """The state at ``mid`` on the audit-least of the cheapest ways from ``state``.

    Edits over a row end in the one letter of that row, so no two are each other's
    beginnings, and the first row where two ways differ decides between them.
    """
    crossing = list(range(4))
    for k in range(mid - 1, lo - 1, -1):
        chosen = [min((c + ends[t], edits, t) for t, (c, edits) in ways.items()) for ways in _MOVES[codes[k]]]
        ends = [c for c, _, _ in chosen]
        crossing = [crossing[t] for _, _, t in chosen]
    return crossing[state]


def cheapest_audit(codes: bytes) -> tuple[int, str]:
    """(cost, edits) for rows given as ``4 * initial + fault``."""
    audit: list[str] = []
    total, at = 0, 0
    # spans still to solve, the next on top: a bound of None is the end of the conversation
    spans: list[tuple[int, int, int | None]] = [(0, len(codes), None)] if codes else []
    while spans:
        lo, hi, target = spans.pop()
        ends = list(_END) if target is None else [0 if s == target else _NEVER for s in range(4)]
        if hi - lo == 1:
            _, edits, to = min((c + ends[t], edits, t) for t, (c, edits) in _MOVES[codes[lo]][at].items())
            total += _MOVES[codes[lo]][at][to][0]
            audit.append(edits)
            at = to
            continue
        mid = (lo + hi) // 2
        first, second = _forward(codes, lo, mid, at), _backward(codes, mid, hi, ends)
        sums = [a + b for a, b in zip(first, second, strict=True)]
        crossings = [s for s in range(4) if sums[s] == min(sums)]
        cross = crossings[0] if len(crossings) == 1 else _least_crossing(codes, lo, mid, at, second)
        spans += [(mid, hi, target), (lo, mid, cross)]
    audit.append(_TAIL[at])
    return total + _END[at], "".join(audit)


def _keyed(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(c, turn, role, text, h1, h2) with nulls as one space and the hashes by which equal rows are told."""
    named = rows.select(F.col(conv).alias("c"), F.col(turn).alias("turn"), *(F.coalesce(F.col(x), F.lit(" ")).alias(y) for x, y in ((role, "role"), (text, "text"))))
    return named.withColumn("h1", F.xxhash64("role", "text")).withColumn("h2", F.xxhash64(F.lit(12), "text", "role"))


def _initial(role: str) -> Column:
    """Place of the role's first character in ``sua``; 3 for any other and for none."""
    place = F.expr(f"locate(substring({role}, 1, 1), '{_INITIALS}')")
    return F.when((F.col(role) == "") | (place == 0), 3).otherwise(place - 1)


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("h1"), F.col("h2")]


def _by_conversation(df: DataFrame, *order: Column) -> DataFrame:
    """A conversation's rows together and in order; Spark's sort spills, so one of any length fits."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, "c").sortWithinPartitions(F.col("c").asc_nulls_first(), *order)


def _audit_stream(kind: pa.DataType) -> Callable:
    schema = pa.schema([("c", kind), *((x, pa.int64()) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])

    def audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> tuple:
            cost, audit = cheapest_audit(bytes(codes))
            gaps = high - low + 1 - turns if turns else 0
            return now, gaps, counts[_BLANK], counts[_COPY], counts[_CUT], illegal, cost, audit

        now = codes = None
        done: list[tuple] = []
        for batch in batches:
            for c, turn, initial, fault, copies in zip(*(batch[x].to_pylist() for x in ("c", "turn", "initial", "fault", "copies")), strict=True):
                if codes is None or c != now:
                    if codes is not None:
                        done.append(close())
                    now, codes, counts, turns, low, high, illegal, last = c, bytearray(), [0] * 4, 0, None, None, 0, None
                if turn is not None and (high is None or turn != high):
                    low, high, turns = turn if low is None else low, turn, turns + 1
                # copies of a row are interchangeable: all but the first repeat it
                again = fault if fault == _BLANK else _COPY
                codes.append(4 * initial + fault)
                codes.extend(bytes([4 * initial + again]) * (copies - 1))
                counts[fault] += 1
                counts[again] += copies - 1
                if last is not None and (last, initial) not in ((0, 1), (1, 2), (2, 1)):
                    illegal += 1
                illegal += copies - 1  # no role may follow itself
                last = initial
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in done], schema)
                done = []
        if codes is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, close(), strict=True))], schema)

    return audits


def conversation_audits(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit): faults and cheapest edits of each conversation.

    Rows go by turn, nulls first; rows of one turn by role, then by a hash of role
    and text, so equal rows stand together. A null role or text counts as one
    space, and a null id is a conversation of its own. Only a row's first fault
    counts: without a visible character, equal in role and text to an earlier
    row, last visible character not one of ``.!?``. Turns are whole numbers.
    Texts of any length are hashed where they are read; what is sorted is one
    record for each different row and turn. Other columns aren't read, whatever
    their names. An empty table has no conversations.
    """
    keyed = _keyed(rows, conv_col, turn_col, role_col, text_col)
    visible = F.rtrim(F.col("text"), F.lit(SPACES))
    small = keyed.select(
        "c", "turn", "role", "h1", "h2", _initial("role").cast("int").alias("initial"),
        F.when(visible == "", F.lit(_BLANK)).when(F.right(visible, F.lit(1)).isin(".", "!", "?"), F.lit(_FINE)).otherwise(F.lit(_CUT)).alias("own"),
    )
    counted = small.groupBy("c", "turn", "role", "h1", "h2", "initial", "own").agg(F.count(F.lit(1)).alias("copies"))
    firsts = small.filter(F.col("own") != _BLANK).groupBy("c", "h1", "h2").agg(F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("unplaced"))
    firsts = firsts.select(F.col("c").alias("fc"), F.col("h1").alias("f1"), F.col("h2").alias("f2"), F.when(~F.col("unplaced"), F.col("least")).alias("first_turn"))
    met = counted.join(firsts, F.col("c").eqNullSafe(F.col("fc")) & (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2")), "left")
    fault = F.when((F.col("own") == _BLANK) | F.col("turn").eqNullSafe(F.col("first_turn")), F.col("own")).otherwise(F.lit(_COPY))
    ready = met.select("c", F.col("turn").cast("long").alias("turn"), "role", "h1", "h2", "initial", fault.cast("int").alias("fault"), "copies")
    kind = rows.schema[conv_col].dataType
    schema = T.StructType([T.StructField("c", kind), *(T.StructField(x, T.LongType()) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), T.StructField("audit", T.StringType())])
    return _by_conversation(ready, *_order()).mapInArrow(_audit_stream(_arrow_type(kind)), schema).withColumnRenamed("c", conv_col)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conversation, None, None, None) where one begins, then (conversation, edit, role, text) for each row that it has after repair."""
    letters, at, now = iter(""), 0, None

    def inserted() -> Iterator[tuple]:
        nonlocal at
        for edit in letters:
            if edit != "I":
                yield edit
                return
            yield now, "I", _WANTED[at], ""
            at = _AFTER_WANTED[at]

    for batch in batches:
        for c, audit, role, text in zip(*(batch[x].to_pylist() for x in ("c", "audit", "role", "text")), strict=True):
            if audit is not None:
                yield from inserted()
                letters, at, now = iter(audit), 0, c
                yield now, None, None, None
                continue
            for edit in inserted():
                if isinstance(edit, tuple):
                    yield edit
                elif edit == "R":
                    yield now, "R", _WANTED[at], text
                    at = _AFTER_WANTED[at]
                elif edit == "K":
                    yield now, "K", role, text
                    at = _AFTER_KEPT[_INITIALS.index(role[0])][at]
    yield from inserted()


def _with_audits(rows: DataFrame, audits: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Each conversation's audit, then its rows in order."""
    keyed = _keyed(rows, conv, turn, role, text).withColumn("audit", F.lit(None).cast("string"))
    heads = audits.select(F.col(conv).alias("c"), "audit")
    both = heads.unionByName(keyed, allowMissingColumns=True)
    return _by_conversation(both, F.col("audit").isNull(), *_order()).select("c", "audit", "role", "text")


def repaired(rows: DataFrame, audits: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, place, edit, role, text): the conversations after the edits of ``audits``; ``place`` counts from 0, ``edit`` is K, R or I.

    Deleted rows are left out, and so is a conversation of which no row stays. Nulls
    and ties as in ``conversation_audits``; the rows must be those audited.
    """
    arrow = _arrow_type(rows.schema[conv_col].dataType)
    out = pa.schema([("c", arrow), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, place = [], 0, 0
        for c, edit, role, text in _edited(batches):
            if edit is None:
                place = 0
                continue
            held.append({"c": c, "place": place, "edit": edit, "role": role, "text": text})
            place, size = place + 1, size + len(text) + 50
            if size > 1 << 20:
                yield pa.RecordBatch.from_pylist(held, out)
                held, size = [], 0
        yield pa.RecordBatch.from_pylist(held, out)

    schema = T.StructType([T.StructField("c", rows.schema[conv_col].dataType), T.StructField("place", T.LongType()), *(T.StructField(x, T.StringType()) for x in ("edit", "role", "text"))])
    return _with_audits(rows, audits, conv_col, turn_col, role_col, text_col).mapInArrow(stream, schema).withColumnRenamed("c", conv_col)


def repaired_digests(rows: DataFrame, audits: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, repaired_sha256): digest of each audited conversation's ``role:text`` lines after the edits, taken as they pass."""
    out = pa.schema([("c", _arrow_type(rows.schema[conv_col].dataType)), ("repaired_sha256", pa.string())])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, now, first, done = None, None, True, []
        for c, edit, role, text in _edited(batches):
            if edit is None:
                if sha is not None:
                    done.append({"c": now, "repaired_sha256": sha.hexdigest()})
                sha, now, first = hashlib.sha256(), c, True
                if len(done) >= 4096:
                    yield pa.RecordBatch.from_pylist(done, out)
                    done = []
                continue
            sha.update(f"{'' if first else chr(10)}{role}:{text}".encode("utf-8", "replace"))
            first = False
        if sha is not None:
            done.append({"c": now, "repaired_sha256": sha.hexdigest()})
        yield pa.RecordBatch.from_pylist(done, out)

    schema = T.StructType([T.StructField("c", rows.schema[conv_col].dataType), T.StructField("repaired_sha256", T.StringType())])
    return _with_audits(rows, audits, conv_col, turn_col, role_col, text_col).mapInArrow(stream, schema).withColumnRenamed("c", conv_col)


def damaged(rows: DataFrame) -> DataFrame:
    """``conversations`` with rows dropped, emptied, cut, repeated and re-roled by a checksum of their place; nulls become one space."""
    space = F.lit(" ")
    place = F.concat_ws(":", *(F.coalesce(F.col(x).cast("string"), space) for x in ("conv_id", "turn")))
    hit = rows.select("conv_id", "turn", "role", "text", (F.crc32(place) % 20).alias("hit")).filter("hit <> 0")
    text = F.when(F.col("hit") == 1, F.lit("")).when(F.col("hit") == 2, F.regexp_replace(F.coalesce("text", space), "[.!?]", "")).otherwise(F.coalesce("text", space))
    role = F.when(F.col("hit") == 4, F.lit("user")).otherwise(F.coalesce("role", space))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("hit") == 3, 2).otherwise(1)))
    return hit.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """All conversations, damaged as the contract says, with their faults, edits and the digest of the repaired rows."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    bad = damaged(rows)
    audits = Scratch(spark, "op12").stash(conversation_audits(bad), "audits")
    digests = repaired_digests(bad, audits)
    ids = rows.select("conv_id").distinct()
    found = audits.join(digests.withColumnRenamed("conv_id", "d"), F.col("conv_id").eqNullSafe(F.col("d"))).drop("d").withColumnRenamed("conv_id", "f")
    out = ids.join(found, F.col("conv_id").eqNullSafe(F.col("f")), "left")
    counts = (F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


OP12_SQL = r"""
WITH RECURSIVE base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), crc AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(8 * length(k)), lambda i: ((ord(substr(k, (i // 8 + 1)::BIGINT, 1)) >> (i % 8)::INTEGER) & 1)::BIGINT)),
    lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295::BIGINT) % 20 AS hit FROM base
), bad AS (
  SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
    CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE hit WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM crc
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM bad
), faults AS (
  SELECT *, substr(role, 1, 1) AS r, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'fine' END AS fault FROM placed
), inserts(s, s2, c, e) AS (
  VALUES (0, 0, 0, ''), (0, 2, 3, 'I'), (0, 3, 6, 'II'), (1, 1, 0, ''), (1, 2, 3, 'I'), (1, 3, 6, 'II'), (2, 2, 0, ''), (2, 3, 3, 'I'), (3, 3, 0, ''), (3, 2, 3, 'I')
), edits(s2, t, r, c, e, gone) AS (
  VALUES (0, 0, '', 4, 'D', true), (1, 1, '', 4, 'D', true), (2, 2, '', 4, 'D', true), (3, 3, '', 4, 'D', true),
    (0, 2, '', 3, 'R', false), (1, 2, '', 3, 'R', false), (2, 3, '', 3, 'R', false), (3, 2, '', 3, 'R', false),
    (0, 1, 's', 0, 'K', false), (0, 2, 'u', 0, 'K', false), (1, 2, 'u', 0, 'K', false), (3, 2, 'u', 0, 'K', false), (2, 3, 'a', 0, 'K', false)
), steps AS (
  SELECT s, t, r, i.c + d.c AS c, i.e || d.e AS e, gone FROM inserts i JOIN edits d USING (s2)
), convs AS (
  SELECT conv_id, max(i) AS n, sum((fault = 'blank')::INT) AS blank, sum((fault = 'duplicate')::INT) AS duplicate, sum((fault = 'truncated')::INT) AS truncated,
    sum((before IS NOT NULL AND (before || r) NOT IN ('su', 'ua', 'au'))::INT) AS illegal, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM faults GROUP BY conv_id
), ways AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS s, {'c': 0::BIGINT, 'e': ''} AS best FROM convs
  UNION ALL
  SELECT w.conv_id, f.i, p.t, min({'c': w.best.c + p.c + CASE WHEN f.fault = 'truncated' AND NOT p.gone THEN 3 ELSE 0 END, 'e': w.best.e || p.e})
  FROM ways w JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1
    JOIN steps p ON p.s = w.s AND (p.r = '' OR p.r = f.r) AND (p.gone OR f.fault IN ('fine', 'truncated'))
  GROUP BY w.conv_id, f.i, p.t
), audits AS (
  SELECT w.conv_id, min({'c': w.best.c + t.c, 'e': w.best.e || t.e}) AS best
  FROM ways w JOIN convs c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i JOIN (VALUES (0, 0, ''), (1, 6, 'II'), (2, 3, 'I'), (3, 0, '')) t(s, c, e) ON t.s = w.s GROUP BY w.conv_id
), letters AS (
  SELECT conv_id, unnest(range(1, length(best.e) + 1)) AS j, best.e AS e FROM audits
), used AS (
  SELECT conv_id, j, substr(e, j, 1) AS x, sum((substr(e, j, 1) <> 'I')::INT) OVER w AS i, sum((substr(e, j, 1) <> 'D')::INT) OVER w AS k FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY j)
), kept AS (
  SELECT u.conv_id, j, x, k, f.role, CASE WHEN x = 'I' THEN '' ELSE f.text END AS text, first_value(CASE WHEN x = 'K' AND f.r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY u.conv_id ORDER BY j) AS s
  FROM used u LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM u.conv_id AND f.i = u.i WHERE x <> 'D'
), done AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN x = 'K' THEN role WHEN (k - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j)) AS h FROM kept GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(a.best.c, 0)::BIGINT AS cost, coalesce(a.best.e, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN convs c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
  LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
"""
