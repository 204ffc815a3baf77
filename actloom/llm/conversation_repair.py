"""Repair of conversation structure with an automaton that all conversations share.

A conversation becomes a signature, one character for each turn: its role's initial and its fault. The distinct
signatures, read from the end, form a word graph in which equal endings are one node; for one remaining ending
a node holds, for each state of the role grammar, the least cost to go and the first edit of the best audit.
Edits of a node point into the node behind it, so an audit suffix is stored once. Signatures are range
partitioned and sorted by their reverse: a task walks the graph depth first, makes every node once and holds one
path only. Conversations take costs and audits back by their signature; frequent signatures are salted.

The grammar of role initials is (s?(ua)+)?. Of the cheapest edit lists the ASCII-least audit counts. From any
state, Delete, Insert, Keep and Rerole each lead to one state, so the first character decides between equal
costs.

A conversation's turns are put in order by range partitions that may cut it anywhere, and its texts are hashed
in a stream; a task holds one byte a turn and never all texts. The SHA-256 of one conversation is a chain and
stays one task's time.

Defined cases: null conv_id, turn, role and text count as one space in the checksum, role and text also in the
turn; rows of a null conv_id are one conversation; equal turns are ordered by role and a digest of role and
text; repeated rows are turns of their own (duplicates); an empty role has no initial; a conversation without
rows after damage has zeros and the hash of the empty text; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from os.path import commonprefix

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from actloom.llm.common import CRC_TABLE, crc32_sql, map_rows, stage_table

#: White space of a text, and what may end one.
BLANKS = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
#: States: nothing yet, after system, after user, after assistant. Where a new user or assistant turn leads.
NEXT = (2, 2, 3, 2)
KEEP = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
#: Costs and first edits where no turn is left.
END = ((0, 2 * INSERT, INSERT, 0), ".II.")
NEVER = 1 << 60
#: A signature of more than this share of all conversations is salted; there are fewer of them than this.
HEAVY_SHARE = 256
SEGMENT = (
    "conv_id long, at long, signature string, roles string, blank long, duplicate long, truncated long,"
    " low long, high long, n_turns long"
)
RESULT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string,"
    " repaired_sha256 string"
)
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]


def damaged(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (0: dropped) after the damage that crc32 of conv_id:turn decides."""
    spelt = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(spelt("conv_id"), F.lit(":"), spelt("turn")).cast("binary")) % 20
    text = F.when(h == 1, "").when(h == 2, F.regexp_replace(spelt("text"), "[.!?]", "")).otherwise(spelt("text"))
    return df.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(h == 4, "user").otherwise(spelt("role")).alias("role"), text.alias("text"),
        F.when(h == 0, 0).when(h == 3, 2).otherwise(1).alias("copies"),
    )


def digest() -> Column:
    return F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))


def flagged(turns: DataFrame) -> DataFrame:
    """Equal turns in one row with their number, without the text: blank, ended, first (no earlier turn of the
    same role and text). Dropped turns stay with number 0, so that every conversation stays."""
    body = F.rtrim("text", F.lit(BLANKS))
    rows = turns.select(
        "conv_id", "turn", "role", digest().alias("digest"), "copies",
        (body == "").alias("blank"), F.right(body, F.lit(1)).isin(*ENDS).alias("ended"),
    )
    counted = rows.groupBy("conv_id", "turn", "role", "digest").agg(
        F.sum("copies").alias("n"), F.first("blank").alias("blank"), F.first("ended").alias("ended")
    )
    # A dropped turn was never seen: it sorts behind the others.
    order = Window.partitionBy("conv_id", "role", "digest").orderBy((F.col("n") == 0), F.col("turn").asc_nulls_first())
    return counted.withColumn("first", F.row_number().over(order) == 1)


def segments(rows: DataFrame) -> DataFrame:
    """Rows of flagged() in order, cut into ranges: for each range and conversation its part of the signature."""
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "digest")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", "turn", F.left("role", F.lit(1)).alias("initial"), "n", "blank", "ended", "first",
        F.spark_partition_id().alias("part"),
    )

    def make():
        names = [x.strip().split(" ")[0] for x in SEGMENT.split(",")]
        blocks = 0

        def work(cols: dict) -> dict:
            nonlocal blocks
            blocks += 1
            out: dict = {n: [] for n in names}
            last, new = None, True
            for conv, turn, initial, n, blank, ended, first, part in zip(*(cols[c] for c in cols)):
                if new or conv != last:
                    for name, value in zip(names, (conv, part << 32 | blocks, [], [], 0, 0, 0, None, None, 0)):
                        out[name].append(value)
                    last, new, seen = conv, False, set()
                if not n:
                    continue
                role = initial if initial in KEEP else "x"
                kept = 0 if blank or not first else 1
                truncated = kept and not ended
                out["signature"][-1].append((role.upper() if truncated else role) * kept + "d" * (n - kept))
                out["roles"][-1].append(role * n)
                out["blank"][-1] += n if blank else 0
                out["duplicate"][-1] += 0 if blank else n - kept
                out["truncated"][-1] += int(truncated)
                if turn is not None:
                    out["n_turns"][-1] += turn != out["high"][-1]
                    out["high"][-1] = turn
                    if out["low"][-1] is None:
                        out["low"][-1] = turn
            for name in ("signature", "roles"):
                out[name] = ["".join(x) for x in out[name]]
            return out

        return work

    return map_rows(placed, SEGMENT, make, rows_at_once=65_536)


def signatures(parts: DataFrame) -> DataFrame:
    """One row for each conversation: its whole signature and counts."""
    names = ["at", "signature", "roles", "blank", "duplicate", "truncated", "low", "high", "n_turns"]
    held = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("s"))
    joined = lambda name: F.array_join(F.transform("s", lambda x: x[name]), "")
    total = lambda name: F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x[name])
    roles = F.col("roles")
    legal = sum((F.length(roles) - F.length(F.replace(roles, F.lit(p), F.lit("")))) / 2 for p in ("su", "ua", "au"))
    timed = F.filter("s", lambda x: x["n_turns"] > 0)
    # A turn on both sides of a cut was counted twice.
    twice = F.size(F.filter(F.arrays_zip(
        F.transform("timed", lambda x: x["low"]).alias("low"),
        F.concat(F.array(F.lit(None).cast("long")), F.transform("timed", lambda x: x["high"])).alias("before"),
    ), lambda x: x["low"] == x["before"]))
    span = F.element_at("timed", -1)["high"] - F.element_at("timed", 1)["low"] + 1
    return (
        held.select("conv_id", "s", joined("signature").alias("signature"), joined("roles").alias("roles"), timed.alias("timed"))
        .select(
            "conv_id", "signature",
            F.when(F.size("timed") > 0, span - total("n_turns") + twice).otherwise(0).cast("long").alias("gaps"),
            *(total(n).alias(n) for n in ("blank", "duplicate", "truncated")),
            (F.greatest(F.length(roles) - 1, F.lit(0)) - legal).cast("long").alias("illegal"),
        )
    )


def node(symbol: str, behind: tuple[int, ...]) -> tuple[tuple[int, ...], str]:
    """Costs to go and first edits, by state, of a turn in front of a node with these costs."""
    role, extra = symbol.lower(), TRUNCATED if symbol.isupper() else 0
    options = []
    for q in range(4):
        here = [(DELETE + behind[q], "D")]
        if role != "d":
            here.append((extra + REROLE + behind[NEXT[q]], "R"))
            to = KEEP[role][q] if role in KEEP else None
            if to is not None:
                here.append((extra + behind[to], "K"))
        options.append(min(here))
    # Two inserts lead back to the same state, so at most one precedes an edit after user or assistant.
    two = min(options[2], (INSERT + options[3][0], "I"))
    three = min(options[3], (INSERT + options[2][0], "I"))
    best = [min(options[0], (INSERT + two[0], "I")), min(options[1], (INSERT + two[0], "I")), two, three]
    return tuple(c for c, _ in best), "".join(e for _, e in best)


class Walk:
    """Nodes of one path through the word graph; reversed signatures come in sorted order."""

    def __init__(self):
        self.path, self.last, self.made = [END], "", 0

    def best(self, reverse: str) -> tuple[int, str]:
        """Least cost and its audit."""
        shared = len(commonprefix([self.last, reverse]))
        del self.path[shared + 1 :]
        for symbol in reverse[shared:]:
            self.path.append(node(symbol, self.path[-1][0]))
            self.made += 1
        self.last = reverse
        at, q, audit = len(reverse), 0, []
        while (edit := self.path[at][1][q]) != ".":
            audit.append(edit)
            if edit != "I":
                at -= 1
            if edit in "IR":
                q = NEXT[q]
            elif edit == "K":
                q = KEEP[reverse[at].lower()][q]
        return self.path[-1][0][0], "".join(audit)


def repaired(distinct: DataFrame) -> DataFrame:
    """signature, cost and audit of distinct signatures, each node of the word graph made once in a range."""
    reverse = distinct.select(F.reverse("signature").alias("reverse")).repartitionByRange("reverse").sortWithinPartitions("reverse")

    def make():
        walk = Walk()

        def work(cols: dict) -> dict:
            found = [walk.best(x) for x in cols["reverse"]]
            return {"signature": [x[::-1] for x in cols["reverse"]], "cost": [c for c, _ in found], "audit": [a for _, a in found]}

        return work

    return map_rows(reverse, "signature string, cost long, audit string", make)


def audited(conversations: DataFrame) -> DataFrame:
    """Conversations of signatures() with cost and audit. Frequent signatures meet in several groups."""
    counted = stage_table(conversations.groupBy("signature").agg(F.count(F.lit(1)).alias("n")), "conversation-signatures")
    share = (counted.agg(F.sum("n")).first()[0] or 0) // HEAVY_SHARE + 1
    salts = F.ceil(F.col("n") / share).cast("int")
    best = stage_table(repaired(counted), "conversation-audits").join(counted, "signature")
    spread = best.select("signature", "cost", "audit", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    # Fewer than HEAVY_SHARE rows of two numbers, whatever the table's size.
    heavy = counted.filter(F.col("n") > share).select(F.xxhash64("signature").alias("h"), salts.alias("salts"))
    heavy = heavy.groupBy("h").agg(F.min("salts").alias("salts"))
    keyed = conversations.withColumn("h", F.xxhash64("signature")).join(F.broadcast(heavy), "h", "left")
    salt = F.pmod(F.xxhash64("conv_id"), F.coalesce("salts", F.lit(1)))
    return keyed.withColumn("salt", salt.cast("int")).join(spread, ["signature", "salt"]).select("conv_id", *COUNTS, "cost", "audit")


class Writer:
    """Applies an audit to the turns of a conversation as they come and hashes what results."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.sha, self.gap = audit, 0, 0, hashlib.sha256(), b""

    def line(self, role: str, text: str) -> None:
        self.sha.update(b"%s%s:%s" % (self.gap, role.encode(), text.encode()))
        self.gap = b"\n"

    def new_role(self) -> str:
        self.state = NEXT[self.state]
        return "user" if self.state == 2 else "assistant"

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.line(self.new_role(), "")

    def turn(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = KEEP[role[0]][self.state]
            self.line(role, text)
        elif edit == "R":
            self.line(self.new_role(), text)


def written(turns: DataFrame, found: DataFrame) -> DataFrame:
    """The result rows: a conversation's audit comes first in its partition, then its turns, then its end."""
    null = lambda kind: F.lit(None).cast(kind)
    marks = found.select(
        "conv_id", F.explode(F.array(F.lit(0), F.lit(2))).alias("kind"), null("long").alias("turn"), null("string").alias("role"),
        null("binary").alias("digest"), null("string").alias("text"), F.lit(0).alias("copies"), *COUNTS, "cost", "audit",
    )
    texts = turns.filter("copies > 0").select(
        "conv_id", F.lit(1).alias("kind"), "turn", "role", digest().alias("digest"), "text", "copies",
        *(null("long").alias(c) for c in [*COUNTS, "cost"]), null("string").alias("audit"),
    )
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "kind", "turn", "role", "digest")]
    rows = marks.unionByName(texts).repartition("conv_id").sortWithinPartitions(*order).drop("digest", "turn")

    def make():
        writer = Writer("")
        names = [x.strip().split(" ")[0] for x in RESULT.split(",")]

        def work(cols: dict) -> dict:
            nonlocal writer
            out: dict = {n: [] for n in names}
            for i, kind in enumerate(cols["kind"]):
                if kind == 0:
                    writer = Writer(cols["audit"][i])
                elif kind == 1:
                    for _ in range(cols["copies"][i]):
                        writer.turn(cols["role"][i], cols["text"][i])
                else:
                    writer.inserts()
                    for n in names[:-1]:
                        out[n].append(cols[n][i])
                    out["repaired_sha256"].append(writer.sha.hexdigest())
            return out

        return work

    return map_rows(rows, RESULT, make, rows_at_once=4096)


def repair(df: DataFrame) -> DataFrame:
    """Damage, count, audit and repair conversations (conv_id, turn, role, text); one row for each conv_id."""
    turns = damaged(df)
    rows = stage_table(flagged(turns), "conversation-turns")  # ranges are cut from a stored table
    conversations = stage_table(signatures(segments(rows)), "conversations")
    return written(turns, audited(conversations))


def query(spark, sf_dir: str) -> DataFrame:
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def _step(state: int, keeps: str, to: int) -> str:
    """Cheapest edit of one turn from a state, inserts aside: the least of (cost, audit)."""
    return f"""list_sort([{{'c': 2 + c{state}, 'a': 'D' || a{state}}},
      {{'c': CASE WHEN gone THEN 1000000000 ELSE 1 + extra + c{to} END, 'a': 'R' || a{to}}},
      {{'c': CASE WHEN gone OR NOT ({keeps}) THEN 1000000000 ELSE extra + kc{state} END, 'a': 'K' || ka{state}}}])[1] AS b{state}"""


ORACLE = f"""
WITH RECURSIVE {CRC_TABLE}, hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS h
  FROM conversations, tab
), damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE h WHEN 0 THEN []::INTEGER[] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hashed
), ordered AS (
  SELECT *, left(role, 1) AS r,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text), copy) AS pos,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
  FROM damaged
), turns AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate'
      WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(r) OVER (PARTITION BY conv_id ORDER BY pos) || r AS two
  FROM ordered
), counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (two IS NOT NULL AND two NOT IN ('su', 'ua', 'au')) AS illegal
  FROM turns GROUP BY conv_id
), dp AS (
  SELECT conv_id, n + 1 AS pos, 0 AS c0, '' AS a0, 10 AS c1, 'II' AS a1, 5 AS c2, 'I' AS a2, 0 AS c3, '' AS a3 FROM counts
  UNION ALL
  SELECT conv_id, pos, f0.c, f0.a, f1.c, f1.a, f2.c, f2.a, f3.c, f3.a FROM (
    SELECT conv_id, pos, f2, f3, list_sort([b0, {{'c': 5 + f2.c, 'a': 'I' || f2.a}}])[1] AS f0,
      list_sort([b1, {{'c': 5 + f2.c, 'a': 'I' || f2.a}}])[1] AS f1
    FROM (
      SELECT conv_id, pos, b0, b1, list_sort([b2, {{'c': 5 + b3.c, 'a': 'I' || b3.a}}])[1] AS f2,
        list_sort([b3, {{'c': 5 + b2.c, 'a': 'I' || b2.a}}])[1] AS f3
      FROM (
        SELECT conv_id, pos, {_step(0, "r IN ('s', 'u')", 2)}, {_step(1, "r = 'u'", 2)}, {_step(2, "r = 'a'", 3)}, {_step(3, "r = 'u'", 2)}
        FROM (
          SELECT t.conv_id, t.pos, t.r, t.fault IN ('blank', 'duplicate') AS gone, CASE WHEN t.fault = 'truncated' THEN 5 ELSE 0 END AS extra,
            c0, a0, c1, a1, c2, a2, c3, a3, CASE WHEN t.r = 's' THEN c1 ELSE c2 END AS kc0, CASE WHEN t.r = 's' THEN a1 ELSE a2 END AS ka0,
            c2 AS kc1, a2 AS ka1, c3 AS kc2, a3 AS ka2, c2 AS kc3, a2 AS ka3
          FROM dp JOIN turns t ON t.conv_id IS NOT DISTINCT FROM dp.conv_id AND t.pos = dp.pos - 1
        )
      )
    )
  )
), edits AS (
  SELECT conv_id, i, audit[i] AS e, count(*) FILTER (audit[i] <> 'I') OVER w AS pos, count(*) FILTER (audit[i] <> 'D') OVER w - 1 AS j,
    length(audit) - length(replace(audit, 'D', '')) AS gone, length(audit) AS size
  FROM (SELECT conv_id, a0 AS audit, unnest(range(1, length(a0) + 1)) AS i FROM dp WHERE pos = 1)
  WINDOW w AS (PARTITION BY conv_id ORDER BY i)
), texts AS (
  SELECT e.conv_id, string_agg(CASE WHEN e.e = 'K' THEN t.role WHEN (j - (size - gone) % 2) % 2 = 0 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN e.e = 'I' THEN '' ELSE t.text END, chr(10) ORDER BY i) AS whole
  FROM edits e LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM e.conv_id AND t.pos = e.pos AND e.e <> 'I'
  WHERE e.e <> 'D' GROUP BY e.conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(c0, 0)::BIGINT AS cost, coalesce(a0, '') AS audit,
  sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN dp ON dp.conv_id IS NOT DISTINCT FROM o.conv_id AND dp.pos = 1
LEFT JOIN texts x ON x.conv_id IS NOT DISTINCT FROM o.conv_id
"""
