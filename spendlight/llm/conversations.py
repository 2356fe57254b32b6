"""Repair of conversation structure: the cheapest edits by Viterbi with coalescing survivors.

A repaired conversation's role initials are nothing, or an optional ``s`` and then one or more ``ua``.
Keeping a turn costs 0, giving it the role user or assistant 2, deleting it 3 (blank and duplicate
turns must go), inserting an empty turn of user or assistant 2; a truncated turn that stays costs 1 more.
Of the cheapest edits those whose initials (D, I, K, R) are least in ASCII order are taken.

The states are where the initials have got to: nothing yet, after ``s``, after ``u``, after ``a``.
Survivors (one a state) are leaves of a tree of backpointers whose nodes count the nodes that refer to them; a
node nobody refers to goes, and what all survivors have in common is emitted at once, so that memory
holds no more than the edits that are still open. Inserts are written before the turn they precede, so no survivor's edits begin
another's, and equal costs are decided by the complete open edits: an order of the survivors kept from turn to turn, then
the new edits. A survivor that even the best continuation can't save is dropped.

Conversations are cut into blocks of BLOCK turns, which are solved apart, from every state one can be
entered in; a conversation is then solved over its blocks in the same way, one row a block. So a very
long conversation is spread over the cluster; turns are numbered by range cells, never by one window.

Order of turns: ``turn`` (nulls first), then role, then text. Nulls: a null role or text is one
space; a null conv_id is one conversation of its own. Repeated rows are turns that repeat. Conversations
without turns have none to repair; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlight.llm.tables import table
from spendlight.operators.ranking import ranked
from spendlight.storage import scratch, store

#: Turns that are solved together.
BLOCK = 4096
WHITE = " \t\n\x0b\x0c\r"
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 2, 3, 2, 1
FINE, LOST, SHORT = range(3)
#: Edits as letters in the order of their initials; J and S are I and R for an assistant's turn.
DELETED, NEW_USER, NEW_ASSISTANT, KEPT, AS_USER, AS_ASSISTANT = "DIJKRS"
#: The turns that must be inserted where a conversation ends in a state.
TAIL = {NOTHING: "", SYSTEM: NEW_USER + NEW_ASSISTANT, USER: NEW_ASSISTANT, ASSISTANT: ""}
#: EXTRA[x][y]: by how much the cheapest way on from x can be dearer than that from y.
EXTRA = ((0, 0, 2, 0), (4, 0, 2, 4), (5, 2, 0, 2), (3, 0, 2, 0))


def _moves(letter: str, fault: int) -> list[tuple[int, int, int, str]]:
    """``(from, to, cost, edits)``: the best way from state to state over a turn of this role initial and fault."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for start in range(4):
        state, inserted = start, ""
        # two turns are inserted at most: more would come back to a state that was passed
        for _ in range(3 if start in (NOTHING, SYSTEM) else 2):
            follow = ASSISTANT if state == USER else USER
            ways = [(state, DELETE, DELETED)]
            if fault != LOST:
                more = CUT_SHORT if fault == SHORT else 0
                ways.append((follow, REROLE + more, AS_ASSISTANT if follow == ASSISTANT else AS_USER))
                if letter == "s" and state == NOTHING:
                    ways.append((SYSTEM, KEEP + more, KEPT))
                if letter == ("a" if follow == ASSISTANT else "u"):
                    ways.append((follow, KEEP + more, KEPT))
            for end, cost, edit in ways:
                way = (INSERT * len(inserted) + cost, inserted + edit)
                best[start, end] = min(best.get((start, end), way), way)
            inserted += NEW_ASSISTANT if follow == ASSISTANT else NEW_USER
            state = follow
    return [(a, b, cost, edits) for (a, b), (cost, edits) in sorted(best.items())]


MOVES = {(letter, fault): _moves(letter, fault) for letter in ("s", "u", "a", "") for fault in (FINE, LOST, SHORT)}
LEGAL = ("su", "ua", "au")


class Node:
    __slots__ = ("parent", "key", "heirs")

    def __init__(self, parent, key):
        self.parent, self.key, self.heirs = parent, key, []
        if parent is not None:
            parent.heirs.append(self)


class Survivors:
    """The cheapest way to each state, as leaves of a tree whose common stem has been emitted."""

    def __init__(self, state: int):
        self.stem = Node(None, None)
        self.live = {state: (0, 0, self.stem)}
        self.done: list = []

    def step(self, moves) -> None:
        """One turn (or block) on; ``moves`` holds ``(from, to, cost, key)``, where keys are ordered."""
        best: dict[int, tuple] = {}
        for start, end, cost, key in moves:
            before = self.live.get(start)
            if before is not None:
                way = (before[0] + cost, before[1], key, before[2])
                if end not in best or way[:3] < best[end][:3]:
                    best[end] = way
        kept = [(way, end) for end, way in best.items() if all(way[0] <= other[0] + EXTRA[x][end] for x, other in best.items())]
        kept.sort(key=lambda x: x[0][1:3])
        old = [node for _, _, node in self.live.values()]
        self.live = {end: (way[0], place, Node(way[3], way[2])) for place, (way, end) in enumerate(kept)}
        for node in old:
            while not node.heirs and node.parent is not None:
                node.parent.heirs.remove(node)
                node = node.parent
        while len(self.stem.heirs) == 1:
            stem = self.stem.heirs[0]
            self.done.append(stem.key)
            stem.parent, self.stem = None, stem

    def open_edits(self, state: int) -> list:
        node, out = self.live[state][2], []
        while node is not self.stem:
            out.append(node.key)
            node = node.parent
        return out[::-1]

    def ended(self) -> tuple[int, int, str]:
        """``(cost, state, tail)`` of the best way to an end."""
        ends = [(cost + INSERT * len(TAIL[state]), place, TAIL[state], state) for state, (cost, place, _) in self.live.items()]
        cost, _, tail, state = min(ends)
        return cost, state, tail


def _conv():
    """conv_id as a text that is never null."""
    return F.concat(F.when(F.col("conv_id").isNull(), "-").otherwise("+"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")))


def faults(turns: DataFrame, keep=store) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) as ``(conv, conv_id, rank, turn, role, text, initial, fault, kind)``.

    ``rank`` is the place in the conversation from 0; ``fault`` is blank, duplicate, truncated or null; ``kind`` is FINE, LOST
    or SHORT. ``keep`` stores a table, here and below.
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    plain = turns.select(_conv().alias("conv"), "conv_id", "turn", role.alias("role"), text.alias("text"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    placed = ranked(plain, "conv", order).withColumn("rank", F.col("rank") - 1)
    placed = keep(placed.withColumn("print", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
    firsts = keep(placed.groupBy("conv", "print").agg(F.min("rank").alias("rank"))).withColumn("first", F.lit(True)).drop("print")
    both = placed.hint("merge").join(firsts.hint("merge"), ["conv", "rank"], "left")
    bare = F.rtrim("text", F.lit(WHITE))
    fault = F.when(bare == "", "blank").when(F.col("first").isNull(), "duplicate").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated")
    kind = F.when(F.col("fault").isNull(), FINE).when(F.col("fault") == "truncated", SHORT).otherwise(LOST)
    marked = both.withColumn("fault", fault).withColumn("kind", kind).withColumn("initial", F.substring("role", 1, 1))
    return keep(marked.select("conv", "conv_id", "rank", "turn", "role", "text", "initial", "fault", "kind"))


_SOLVED = "conv string, block long, illegal long, first string, last string, ways array<struct<start: int, end: int, cost: long, place: int, edits: string>>"
_WAYS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("place", pa.int32()), ("edits", pa.string())]))


def _ways(tried: dict[int, Survivors]) -> list[dict]:
    out = []
    for start, survivors in tried.items():
        stem = "".join(survivors.done)
        for state, (cost, place, _) in survivors.live.items():
            out.append({"start": start, "end": state, "cost": cost, "place": place, "edits": stem + "".join(survivors.open_edits(state))})
    return out


def solve_blocks(marked: DataFrame, block: int = BLOCK, keep=store) -> DataFrame:
    """Each block's ways from state to state: cost, edits, and the place of the edits among those from the same state."""

    def run(batches):
        at, tried, illegal, first, last = None, {}, 0, "", ""
        columns = ([], [], [], [], [], [])

        def flush():
            for column, value in zip(columns, (*at, illegal, first, last, _ways(tried)), strict=True):
                column.append(value)

        def batch_of():
            types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), _WAYS)
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv", "block", "illegal", "first", "last", "ways"])
            for c in columns:
                c.clear()
            return out

        for batch in batches:
            for conv, number, initial, kind in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (conv, number) != at:
                    if at is not None:
                        flush()
                    at, illegal, first = (conv, number), 0, initial
                    tried = {s: Survivors(s) for s in (range(4) if number else (NOTHING,))}
                elif last + initial not in LEGAL:
                    illegal += 1
                last = initial
                moves = MOVES[initial if initial in ("s", "u", "a") else "", kind]
                for survivors in tried.values():
                    survivors.step(moves)
            yield batch_of()
        if at is not None:
            flush()
            yield batch_of()

    number = F.floor(F.col("rank") / block).cast("long").alias("block")
    slim = marked.select("conv", number, "initial", "kind", "rank")
    dealt = slim.repartition("conv", "block").sortWithinPartitions("conv", "block", "rank").select("conv", "block", "initial", "kind")
    return keep(dealt.mapInArrow(run, _SOLVED))


def choose(solved: DataFrame, keep=store) -> DataFrame:
    """``(conv, block, start, end, tail, cost, illegal)``: the way taken through each block, and a last row a conversation
    (its block is their number, start and end null) with the turns inserted at the end, the cost and the illegal neighbours."""

    def run(batches):
        conv, number, survivors, illegal, last, emitted = None, 0, None, 0, "", 0
        rows: list[tuple] = []

        def emit():
            nonlocal emitted
            for _, start, end in survivors.done:
                rows.append((conv, emitted, start, end, None, None, None))
                emitted += 1
            survivors.done.clear()

        def close():
            nonlocal emitted
            emit()
            cost, state, tail = survivors.ended()
            for _, start, end in survivors.open_edits(state):
                rows.append((conv, emitted, start, end, None, None, None))
                emitted += 1
            rows.append((conv, emitted, None, None, tail, cost, illegal))

        def batch_of():
            types = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            columns = list(zip(*rows, strict=True)) or [()] * 7
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv", "block", "start", "end", "tail", "cost", "illegal"])

        for batch in batches:
            for key, wrong, first, after, ways in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if key != conv:
                    if conv is not None:
                        close()
                    conv, survivors, illegal, emitted = key, Survivors(NOTHING), 0, 0
                elif last + first not in LEGAL:
                    illegal += 1
                illegal, last = illegal + wrong, after
                survivors.step([(w["start"], w["end"], w["cost"], (w["place"], w["start"], w["end"])) for w in ways])
                emit()
            yield batch_of()
        if conv is not None:
            close()
            yield batch_of()

    slim = F.transform("ways", lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), w["cost"].alias("cost"), w["place"].alias("place")))
    dealt = solved.select("conv", "block", "illegal", "first", "last", slim.alias("ways")).repartition("conv").sortWithinPartitions("conv", "block")
    shape = "conv string, block long, start int, end int, tail string, cost long, illegal long"
    return keep(dealt.select("conv", "illegal", "first", "last", "ways").mapInArrow(run, shape))


def edits_of(solved: DataFrame, chosen: DataFrame) -> DataFrame:
    """``(conv, block, edits)``: the edits taken, each turn's ending with what becomes of it; the last row holds the inserted end."""
    every = solved.select("conv", "block", F.explode("ways").alias("w")).select("conv", "block", "w.start", "w.end", "w.edits")
    taken = chosen.where(F.col("start").isNotNull()).select("conv", "block", "start", "end")
    within = every.hint("merge").join(taken.hint("merge"), ["conv", "block", "start", "end"]).select("conv", "block", "edits")
    return within.unionByName(chosen.where("tail != ''").select("conv", "block", F.col("tail").alias("edits")))


def rewrite(marked: DataFrame, edits: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(conv, rank, part, edit, role, text)``: the repaired turns; rank and part order them."""
    groups = F.regexp_extract_all("edits", F.lit("[IJ]*[DKRS]|[IJ]+$"), F.lit(0))
    each = edits.select("conv", "block", F.posexplode(groups).alias("place", "group"))
    # a conversation's inserted end follows its last turn, wherever its last block ended
    each = each.select("conv", F.when(F.rlike("group", F.lit("[DKRS]$")), F.col("block") * block + F.col("place")).otherwise(F.col("block") * block).alias("rank"), "group")
    single = each.select("conv", "rank", F.posexplode(F.split("group", "")).alias("part", "edit")).where(F.col("edit").isin(*"IJKRS"))
    both = single.hint("merge").join(marked.select("conv", "rank", "role", "text").hint("merge"), ["conv", "rank"], "left")
    role = F.when(F.col("edit").isin("I", "R"), "user").when(F.col("edit").isin("J", "S"), "assistant").otherwise(F.col("role"))
    text = F.when(F.col("edit").isin("I", "J"), "").otherwise(F.col("text"))
    return both.select("conv", "rank", "part", F.translate("edit", "JS", "IR").alias("edit"), role.alias("role"), text.alias("text"))


def repair(turns: DataFrame, block: int = BLOCK, keep=store) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``(marked, edits, ends, repaired)`` of ``turns`` (conv_id, turn, role, text).

    ``marked`` is the turns with place and fault (see ``faults``), ``edits`` (conv, block, edits), ``ends`` (conv, cost, illegal)
    and ``repaired`` (conv, rank, part, edit, role, text) the turns of the repaired conversations.
    """
    marked = faults(turns, keep)
    solved = solve_blocks(marked, block, keep)
    chosen = choose(solved, keep)
    edits = keep(edits_of(solved, chosen))
    return marked, edits, chosen.where(F.col("start").isNull()).select("conv", "cost", "illegal"), rewrite(marked, edits, block)


def digests(repaired: DataFrame) -> DataFrame:
    """``(conv, repaired_sha256)`` of ``role:text`` of all turns, joined by newline.

    SHA-256 is taken along a conversation from its first byte to its last, so its turns stream through one task,
    sorted, none of them kept.
    """

    def run(batches):
        conv, digest = None, None
        names = ["conv", "repaired_sha256"]
        for batch in batches:
            out: list[tuple[str, str]] = []
            for key, line in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if key == conv:
                    digest.update(b"\n")
                else:
                    if conv is not None:
                        out.append((conv, digest.hexdigest()))
                    conv, digest = key, hashlib.sha256()
                digest.update(line)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in range(2)], names)
        if conv is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([digest.hexdigest()])], names)

    lines = repaired.select("conv", "rank", "part", F.concat("role", F.lit(":"), "text").alias("line"))
    dealt = lines.repartition("conv").sortWithinPartitions("conv", "rank", "part").select("conv", "line")
    return dealt.mapInArrow(run, "conv string, repaired_sha256 string")


def damage(conversations: DataFrame) -> DataFrame:
    """``conversations`` with faults of all kinds, by crc32 of ``conv_id:turn``; conversations that lose every turn have no row."""
    spaced = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    fate = F.crc32(F.concat(spaced["conv_id"], F.lit(":"), spaced["turn"]).cast("binary")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(spaced["text"], "[.!?]", "")).otherwise(spaced["text"])
    role = F.when(fate == 4, "user").otherwise(spaced["role"])
    copies = F.when(fate == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    kept = conversations.where(fate != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))
    return kept.withColumn("copy", F.explode("copies")).select("conv_id", "turn", "role", "text")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation of the damaged ``conversations``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    conversations = table(spark, sf_dir, "conversations")
    every = conversations.select(_conv().alias("conv"), "conv_id").distinct()
    with scratch(spark) as keep:
        marked, edits, ends, repaired = repair(damage(conversations), keep=keep)
        turns = marked.where(F.col("turn").isNotNull()).groupBy("conv", "turn").agg(F.lit(1).alias("one"))
        gaps = turns.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("one")).alias("gaps"))
        counts = marked.groupBy("conv").agg(*(F.count_if(F.col("fault") == name).alias(name) for name in ("blank", "duplicate", "truncated")))
        audits = edits.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", "edits"))).alias("parts"))
        audits = audits.select("conv", F.translate(F.array_join("parts.edits", ""), "JS", "IR").alias("audit"))
        out = every
        for part in (gaps, counts, ends, audits, digests(repaired)):
            out = out.hint("merge").join(part.hint("merge"), "conv", "left")
        zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        nothing = hashlib.sha256(b"").hexdigest()
        return store(out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256")))


#: The query in DuckDB: crc32 from its table, then the cheapest edits by a recursive table of complete edits for every turn and state.
ORACLE_SQL = r"""with recursive
 crc_table as (select list(c order by i) as tab from (select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) as c from range(256) r(i))),
 fated as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda ch: ascii(ch)::bigint)),
   lambda c, b: xor(c // 256, tab[(xor(c, b) % 256) + 1])), 4294967295) % 20 as fate from conversations, crc_table),
 damaged as (select conv_id, turn, case when fate = 4 then 'user' else role end as role, case when fate = 1 then '' when fate = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
   from fated, range(2) copies(copy) where fate <> 0 and (copy = 0 or fate = 3)),
 placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as rn, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare from damaged),
 marked as (select *, left(role, 1) as initial, case when bare = '' then 'blank' when row_number() over (partition by conv_id, role, text order by rn) > 1 then 'duplicate' when right(bare, 1) not in ('.', '!', '?') then 'truncated' end as fault,
   lag(left(role, 1)) over (partition by conv_id order by rn) as before from placed),
 follow(f, r, t) as (values ('', 's', 's'), ('', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')),
 inserted(f, t, cost, edits, lines) as (select s, s, 0, '', cast([] as varchar[]) from (values (''), ('s'), ('u'), ('a')) v(s) union all values ('', 'u', 2, 'I', ['user:']), ('', 'a', 4, 'II', ['user:', 'assistant:']), ('s', 'u', 2, 'I', ['user:']), ('s', 'a', 4, 'II', ['user:', 'assistant:']), ('u', 'a', 2, 'I', ['assistant:']), ('a', 'u', 2, 'I', ['user:'])),
 ways as (select conv_id, rn, i.f, i.t as mid, i.t as t, i.cost + 3 as cost, i.edits || 'D' as edits, i.lines as lines from marked, inserted i
   union all select conv_id, rn, i.f, i.t, w.t, i.cost + coalesce((fault = 'truncated')::int, 0), i.edits || 'K', list_append(i.lines, role || ':' || text) from marked join inserted i on true join follow w on w.f = i.t and w.r = initial where coalesce(fault, '') not in ('blank', 'duplicate')
   union all select conv_id, rn, i.f, i.t, w.t, i.cost + 2 + coalesce((fault = 'truncated')::int, 0), i.edits || 'R', list_append(i.lines, case w.r when 'u' then 'user:' else 'assistant:' end || text) from marked join inserted i on true join follow w on w.f = i.t and w.r <> 's' where coalesce(fault, '') not in ('blank', 'duplicate')),
 best(conv_id, rn, state, cost, edits, lines) as (select distinct conv_id, 0::bigint, '', 0, '', cast([] as varchar[]) from marked
   union all select b.conv_id, b.rn + 1, w.t, min(b.cost + w.cost), arg_min(b.edits || w.edits, (b.cost + w.cost, b.edits || w.edits)), arg_min(list_concat(b.lines, w.lines), (b.cost + w.cost, b.edits || w.edits)) from best b join ways w on w.conv_id = b.conv_id and w.rn = b.rn + 1 and w.f = b.state group by b.conv_id, b.rn, w.t),
 ended as (select b.conv_id, b.cost + i.cost as cost, b.edits || i.edits as edits, list_concat(b.lines, i.lines) as lines from best b join (select conv_id, max(rn) as last from marked group by 1) m on m.conv_id = b.conv_id and m.last = b.rn join inserted i on i.f = b.state where i.t = 'a' or (b.state = '' and i.t = '')),
 chosen as (select conv_id, arg_min(struct_pack(cost := cost, edits := edits, lines := lines), (cost, edits)) as c from ended group by 1),
 counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
   count(*) filter (rn > 1 and before || initial not in ('su', 'ua', 'au')) as illegal from marked group by 1)
 select conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(c.cost, 0)::bigint as cost, coalesce(c.edits, '') as audit, sha256(coalesce(array_to_string(c.lines, chr(10)), '')) as repaired_sha256
 from (select distinct conv_id from conversations) left join counts using (conv_id) left join chosen using (conv_id)"""
