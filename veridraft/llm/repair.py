"""Cheapest repair of conversations, decided once per shared ending.

Each turn becomes one letter of its conversation's signature: its role (s, u, a, o for others;
capital if the turn is truncated), or x if it has to go. What the cheapest edits of the rest of
a conversation are depends on two things only: the letters still to come, and what the grammar
``(s?(ua)+)?`` expects next. So signatures are read from the end, as an automaton in which equal
endings are one node. Sorted by their reversed form, signatures that share an ending are
neighbours; a task walks them in that order and holds only the path of the current one: every
node is made once, with its cost-to-go for each state of the grammar.

Costs-to-go differ between states by a bounded amount. Nodes that agree in these differences
are one node of the minimised automaton: it has few, however long the conversations, and each
(letter, node) is worked out once. A node keeps for each state the first edit of the best
ending. Edits of a turn, inserts before it included, are never a prefix of one another, so the
ASCII-least of the cheapest endings is found turn by turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from veridraft.llm.common import map_batches, table
from veridraft.session import materialise

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: What the grammar has seen last: nothing, the system turn, a user turn, an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
BLANKS = " \t\n\x0b\f\r"
NEVER = 1 << 40

COUNTS = ["blank", "duplicate", "truncated", "illegal"]
FAULTS = COUNTS[:3]


# The automaton


def _next(state: int) -> int:
    """What an inserted or re-roled turn becomes."""
    return ASSISTANT if state == USER else USER


def edits(letter: str, state: int) -> list[tuple[int, str, int]]:
    """(cost, edit letters, next state) of each way to deal with a turn, inserts before it included.

    Two inserts and then a turn are as dear as the turn and then two inserts, or dearer; three
    are never needed.
    """
    found = [(DELETE, "D", state)]
    if letter == "x":
        return found
    role, price = letter.lower(), TRUNCATED if letter.isupper() else 0
    for inserts in range(3):
        cost, token = price + inserts * INSERT, "I" * inserts
        if role == "s" and state == START and not inserts:
            found.append((cost, token + "K", SYSTEM))
        if role == "ua"[_next(state) - USER]:
            found.append((cost, token + "K", _next(state)))
        found.append((cost + REROLE, token + "R", _next(state)))
        state = _next(state)
    return found


class Automaton:
    """Nodes are numbered by their cost-to-go above the cheapest state's; node 0 is the end."""

    def __init__(self) -> None:
        end = {START: 0, SYSTEM: 2 * INSERT, USER: INSERT, ASSISTANT: 0}
        self.last = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
        self.costs = [tuple(end[s] for s in STATES)]
        self.number = {self.costs[0]: 0}
        self.made: dict[tuple[str, int], tuple[int, int, tuple]] = {}

    def before(self, letter: str, node: int) -> tuple[int, int, tuple]:
        """(node, cost, best (edits, next state) by state) of a letter in front of a node."""
        if (letter, node) not in self.made:
            ahead = self.costs[node]
            best = [min((c + ahead[s], e, s) for c, e, s in edits(letter, state)) for state in STATES]
            base = min(b[0] for b in best)
            costs = tuple(b[0] - base for b in best)
            if costs not in self.number:
                self.number[costs] = len(self.costs)
                self.costs.append(costs)
            self.made[letter, node] = self.number[costs], base, tuple(b[1:] for b in best)
        return self.made[letter, node]


class Endings:
    """The path of one signature, from its end; the next one keeps what it shares."""

    def __init__(self) -> None:
        self.automaton = Automaton()
        self.word = ""
        self.nodes, self.total, self.best = [0], [0], []

    def repair(self, backwards: str) -> tuple[int, str]:
        """(cost, audit) of a signature given in reverse."""
        shared = 0
        for a, b in zip(self.word, backwards):
            if a != b:
                break
            shared += 1
        del self.nodes[shared + 1 :], self.total[shared + 1 :], self.best[shared:]
        for letter in backwards[shared:]:
            node, cost, best = self.automaton.before(letter, self.nodes[-1])
            self.nodes.append(node)
            self.total.append(self.total[-1] + cost)
            self.best.append(best)
        self.word = backwards
        state, audit = START, []
        for best in reversed(self.best):
            token, state = best[state]
            audit.append(token)
        audit.append(self.automaton.last[state])
        return self.total[-1] + self.automaton.costs[self.nodes[-1]][START], "".join(audit)


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    endings = Endings()
    for batch in batches:
        words = batch.column(0).to_pylist()
        found = [endings.repair(w) for w in words]
        yield pa.RecordBatch.from_arrays(
            [pa.array([w[::-1] for w in words], pa.string()), pa.array([c for c, _ in found], pa.int64()),
             pa.array([a for _, a in found], pa.string())],
            ["signature", "cost", "audit"],
        )


def repairs(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit) of every distinct signature."""
    backwards = signatures.select(F.reverse("signature").alias("backwards")).distinct()
    # By range and not by hash: a common ending may be shared by a third of all signatures.
    ordered = backwards.repartitionByRange("backwards").sortWithinPartitions("backwards")
    return map_batches(
        ordered, _repairs, [("signature", T.StringType()), ("cost", T.LongType()), ("audit", T.StringType())]
    )


# Conversations


def _turns(rows: DataFrame, gone: str | None) -> DataFrame:
    """(conv_id, turn, gone, role, text, digest); nulls in role and text are one space."""
    return rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        (F.coalesce(F.col(gone), F.lit(False)) if gone else F.lit(False)).alias("gone"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    ).withColumn("digest", F.unhex(F.sha2("text", 256)))


def _lettered(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, initial, fault, letter): a null letter is no turn."""
    spoken = F.rtrim("text", F.lit(BLANKS))
    first = Window.partitionBy("conv_id", "gone", "role", "digest").orderBy("turn")
    rows = turns.select(
        "conv_id", "turn", "gone", "role", "digest", F.substring("role", 1, 1).alias("initial"),
        (spoken == "").alias("blank"), F.substring(spoken, -1, 1).isin(".", "!", "?").alias("ended"),
    ).withColumn("seen", F.row_number().over(first) > 1)
    role = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    fault = F.when(F.col("blank"), "blank").when(F.col("seen"), "duplicate").when(~F.col("ended"), "truncated")
    letter = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(
        F.col("fault") == "truncated", F.upper(role)
    ).otherwise(role)
    return rows.withColumn("fault", fault).select(
        "conv_id", "turn", "role", "digest", "initial", F.when(~F.col("gone"), F.col("fault")).alias("fault"),
        F.when(~F.col("gone"), letter).alias("letter"),
    )


def _legal(pair: str) -> bool:
    return pair in ("su", "ua", "au")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for the turns of a conversation that lie in this partition."""
    part = TaskContext.get().partitionId()
    conv, piece = None, None
    names = ["part", "letters", "first", "last", "low", "high", "turns", *COUNTS]
    kinds = [pa.int32()] + [pa.string()] * 3 + [pa.int64()] * (3 + len(COUNTS))

    def rows(done, kind):
        values = [[c for c, _ in done]] + [
            ["".join(p[n]) if n == "letters" else p[n] for _, p in done] for n in names
        ]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, [kind, *kinds])], ["conv_id", *names])

    for batch in batches:
        kind, done = batch.schema.field(0).type, []
        for c, turn, initial, fault, letter in zip(*(x.to_pylist() for x in batch.columns)):
            if piece is None or c != conv:
                if piece is not None:
                    done.append((conv, piece))
                conv = c
                piece = dict.fromkeys(["turns", *COUNTS], 0) | dict.fromkeys(["first", "last", "low", "high"])
                piece |= {"part": part, "letters": []}
            if letter is None:
                continue
            if piece["last"] is None:
                piece["first"] = initial
            else:
                piece["illegal"] += not _legal(piece["last"] + initial)
            piece["last"] = initial
            if turn is not None and turn != piece["high"]:
                piece["turns"] += 1
                piece["low"] = turn if piece["low"] is None else piece["low"]
                piece["high"] = turn
            if fault:
                piece[fault] += 1
            piece["letters"].append(letter)
        if done:
            yield rows(done, kind)
    if piece is not None:
        yield rows([(conv, piece)], kind)


def _signatures(turns: DataFrame) -> DataFrame:
    """(conv_id, signature, gaps, blank, duplicate, truncated, illegal), one row per conversation.

    Turns are dealt by range of (conversation, turn), so that a huge conversation is spread; a
    conversation has one piece per partition it touches.
    """
    order = ["conv_id", "turn", "role", "digest"]
    rows = _lettered(turns).repartitionByRange(*order).sortWithinPartitions(*order)
    long, text = T.LongType(), T.StringType()
    fields = [("conv_id", turns.schema["conv_id"].dataType), ("part", T.IntegerType())]
    fields += [(n, text) for n in ("letters", "first", "last")] + [(n, long) for n in ("low", "high", "turns", *COUNTS)]
    pieces = map_batches(rows.select("conv_id", "turn", "initial", "fault", "letter"), _pieces, fields)
    names = [n for n, _ in fields[1:]]
    whole = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("p"))
    whole = whole.withColumn("p", F.expr("filter(p, x -> x.letters <> '')"))

    def total(name: str) -> Column:
        return F.expr(f"aggregate(p, 0L, (n, x) -> n + x.{name})")

    def borders(condition: str) -> Column:
        return F.expr(f"if(size(p) > 1, size(filter(sequence(1, size(p) - 1), i -> {condition})), 0)").cast("long")

    turns_there = total("turns") - borders("coalesce(p[i - 1].high = p[i].low, false)")
    met = borders("concat(p[i - 1].last, p[i].first) NOT IN ('su', 'ua', 'au')")
    return whole.select(
        "conv_id", F.expr("concat_ws('', transform(p, x -> x.letters))").alias("signature"),
        F.coalesce(F.array_max("p.high") - F.array_min("p.low") + 1 - turns_there, F.lit(0)).cast("long").alias("gaps"),
        *(total(n).alias(n) for n in FAULTS), (total("illegal") + met).alias("illegal"),
    )


class Rewriter:
    """Applies an audit to the turns of one conversation, in order."""

    NAMES = {USER: "user", ASSISTANT: "assistant"}

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, START

    def inserts(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at, self.state = self.at + 1, _next(self.state)
            yield "I", self.NAMES[self.state], ""

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the turns that stand for this one."""
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "D":
            return
        self.state = SYSTEM if edit == "K" and role[:1] == "s" else _next(self.state)
        yield edit, role if edit == "K" else self.NAMES[self.state], text


RESULT = ["gaps", *COUNTS, "cost", "audit"]


def _rewritten(digests: bool):
    """Conversations one after another: a row with the audit, then the turns in order."""
    turn_names = ["place", "edit", "role", "text"]
    turn_kinds = [pa.int64(), pa.string(), pa.string(), pa.string()]
    kinds = [pa.int64()] * (1 + len(COUNTS) + 1) + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = writer = sha = None
        place = 0

        def put(found, conv, out):
            nonlocal place
            for edit, role, text in found:
                if digests:
                    sha.update(f"{chr(10) if place else ''}{role}:{text}".encode())
                else:
                    out.append((conv, place, edit, role, text))
                place += 1

        def end(out):
            put(writer.inserts(), head["conv_id"], out)
            if digests:
                out.append((head["conv_id"], *(head[n] for n in RESULT), sha.hexdigest()))

        def batch_of(out, kind):
            names = [*RESULT, "repaired_sha256"] if digests else turn_names
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(zip(*out), [kind, *(kinds if digests else turn_kinds)])],
                ["conv_id", *names],
            )

        for batch in batches:
            out, kind = [], batch.schema.field("conv_id").type
            for row in batch.to_pylist():
                if row["audit"] is not None:
                    if head:
                        end(out)
                    head, writer, sha, place = row, Rewriter(row["audit"]), hashlib.sha256(), 0
                else:
                    put(writer.turn(row["role"], row["text"]), row["conv_id"], out)
            if out:
                yield batch_of(out, kind)
        if head:
            out = []
            end(out)
            if out:
                yield batch_of(out, kind)

    return run


def _repaired(rows: DataFrame, gone: str | None, digests: bool) -> DataFrame:
    turns = _turns(rows, gone)
    found = materialise(_signatures(turns), "repair-signatures")
    audits = found.join(repairs(found.select("signature")), "signature").drop("signature")
    audits = audits.withColumn("kind", F.lit(0))
    texts = turns.where("NOT gone").drop("gone").withColumn("kind", F.lit(1))
    order = ["conv_id", "kind", "turn", "role", "digest"]
    both = audits.unionByName(texts, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions(*order)
    long, text = T.LongType(), T.StringType()
    fields = [("conv_id", turns.schema["conv_id"].dataType)]
    if digests:
        fields += [(n, text if n == "audit" else long) for n in RESULT] + [("repaired_sha256", text)]
    else:
        fields += [("place", long), ("edit", text), ("role", text), ("text", text)]
    return map_batches(both.drop("kind", "turn", "digest"), _rewritten(digests), fields)


def repair_conversations(rows: DataFrame, gone: str | None = None) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text): gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired_sha256.

    Turns stand in the order of ``turn``, nulls first, ties by role and then by SHA-256 of the
    text. A turn's first fault counts: blank, duplicate (same role and text seen earlier) or
    truncated (its last visible character is not ``.``, ``!`` or ``?``). Edits cost: keep 0, new
    role 1, delete 2 (a must for blank and duplicate turns), insert an empty user or assistant
    turn 5, and 5 more for a truncated turn that stays. The audit spells the cheapest edits that
    leave roles ``(s?(ua)+)?``, by initials; of equally cheap ones the ASCII-least.
    repaired_sha256 is of the repaired ``role:text`` lines.

    A null role or text is one space. A null conv_id is a conversation of its own. Null turns
    count neither as gaps nor as distinct turns. Repeated rows are repeated turns. Rows with a
    true ``gone`` only name their conversation; one without other rows has zeros and an empty
    audit. Other columns are not read; no rows give no rows. Texts of any length are read whole.

    The letters of one conversation and its audit are a string each, as the audit is a column of
    the result. Its texts pass through one task, one after another: SHA-256 is a chain.
    """
    return _repaired(rows, gone, digests=True)


def repaired_turns(rows: DataFrame, gone: str | None = None) -> DataFrame:
    """(conv_id, place, edit, role, text): the repaired turns themselves, numbered from 0."""
    return _repaired(rows, gone, digests=False)


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone) with faults planted by crc32 of ``conv_id:turn``."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = rows.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        (F.crc32(key) % 20).alias("d"),
    )
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("d") == 0).alias("gone"), F.explode(F.expr("sequence(1, if(d = 3, 2, 1))")).alias("copy"),
    ).drop("copy")


def op13_conversation_repair(spark, folder: str) -> DataFrame:
    return repair_conversations(damaged(table(spark, folder, "conversations")), gone="gone")


def _option(cost: str, token: str, state: int) -> str:
    """An ending with an edit in front, as nine digits of cost and the audit."""
    return f"printf('%09d', CAST(v{state}[1:9] AS BIGINT) + {cost}) || '{token}' || v{state}[10:]"


def _best(state: int) -> str:
    here, other = _next(state), _next(_next(state))
    never = "'999999999'"
    options = [_option("2", "D", state)]
    stays = "fault IS NULL OR fault = 'truncated'"
    if state == START:
        options.append(f"CASE WHEN ({stays}) AND i = 's' THEN {_option('p', 'K', SYSTEM)} ELSE {never} END")
    for inserts, to in (("", here), ("I", other), ("II", here)):
        cost = f"{5 * len(inserts)} + p"
        initial = "ua"[to - USER]
        options.append(f"CASE WHEN ({stays}) AND i = '{initial}' THEN {_option(cost, inserts + 'K', to)} ELSE {never} END")
        options.append(f"CASE WHEN {stays} THEN {_option(cost + ' + 1', inserts + 'R', to)} ELSE {never} END")
    return f"least({', '.join(options)}) AS v{state}"


OP13_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_concat([i], range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)),
o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
h AS (
  SELECT o.* EXCLUDE (key), xor(list_reduce(
      list_concat([4294967295], list_transform(range(1, length(key) + 1), lambda k: CAST(ascii(key[k]) AS BIGINT))),
      lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 20 AS d
  FROM o, crc),
d AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM h, range(CASE WHEN d = 3 THEN 2 ELSE 1 END) WHERE d <> 0),
n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS r,
    regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS said FROM d),
f AS (
  SELECT *, left(role, 1) AS i, CASE
      WHEN said = '' THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY r) > 1 THEN 'duplicate'
      WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY r) || left(role, 1) AS met
  FROM n),
e AS (SELECT *, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS p FROM f),
c AS (
  SELECT conv_id, count(*) AS n, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (met NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id),
v AS (
  SELECT conv_id, n AS r, '000000000' AS v0, '000000010II' AS v1, '000000005I' AS v2, '000000000' AS v3 FROM c
  UNION ALL
  SELECT v.conv_id, v.r - 1, {', '.join(_best(s) for s in STATES)}
  FROM v JOIN e ON e.conv_id IS NOT DISTINCT FROM v.conv_id AND e.r = v.r),
a AS (SELECT conv_id, CAST(v0[1:9] AS BIGINT) AS cost, v0[10:] AS audit FROM v WHERE r = 0),
l AS (
  SELECT conv_id, k, audit[k] AS edit, length(replace(audit[1:k], 'I', '')) AS r,
    length(replace(audit[1:k], 'D', '')) AS place FROM a, range(1, length(audit) + 1) s(k)),
w AS (
  SELECT l.*, e.role, e.text, e.i,
    coalesce(max(CASE WHEN place = 1 AND edit = 'K' AND e.i = 's' THEN 1 END) OVER (PARTITION BY l.conv_id), 0) AS system
  FROM l LEFT JOIN e ON l.conv_id IS NOT DISTINCT FROM e.conv_id AND l.r = e.r AND l.edit <> 'I'),
t AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - system) % 2 = 1 THEN 'user' ELSE 'assistant' END
      || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS repaired
  FROM w WHERE edit <> 'D' GROUP BY conv_id)
SELECT g.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g
LEFT JOIN c ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN a ON g.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN t ON g.conv_id IS NOT DISTINCT FROM t.conv_id
"""
