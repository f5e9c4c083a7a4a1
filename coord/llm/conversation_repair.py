"""Structure repair of conversations by dynamic programming over Re-Pair symbols."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coord.llm.common import BLANKS, cut_lineage, hot_join
from coord.operators.ordered import lag, over_order, rank

CHUNK_ROWS = 128
ROUNDS, RULES_PER_ROUND = 12, 16  # bounds of the grammar; symbols it leaves apart are multiplied one by one
REMEMBERED = 20_000
ROLES = {"u": "user", "a": "assistant"}
SOUND, ENDS = "suao", ".!?"
DELETE = "x"  # blank or duplicate; a truncated row has the capital of its role
KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 2, 3, 2, 1
STATES = range(4)  # nothing yet, after s, after u, after a
START = 0
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
WANTED = {0: "u", 1: "u", 2: "a", 3: "u"}  # what is inserted or renamed to
TAIL = {0: "", 1: "II", 2: "I", 3: ""}
_FIRST_RULE = 0xE000  # private characters stand for rules

Rope = str | tuple  # text, or two ropes one after the other
Matrix = list  # of (cost, rope) or None, 4 x 4, from state to state


def flat(rope: Rope) -> str:
    """The text of a rope."""
    out, open_ = [], [rope]
    while open_:
        x = open_.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            open_ += [x[1], x[0]]
    return "".join(out)


def better(x, y):
    """The cheaper of two entries, of equally cheap ones that with the least audit."""
    if x is None or y is None:
        return x or y
    if x[0] != y[0]:
        return x if x[0] < y[0] else y
    return x if flat(x[1]) <= flat(y[1]) else y


def row_matrix(symbol: str) -> Matrix:
    """Cheapest inserts before a row and edit of the row, from state to state.

    No audit of a row, or of rows, is the beginning of another of the same rows: each ends with the edit of the last row.
    So the order of audits stays when more follows, and entries can be combined.
    """
    out: Matrix = [None] * 16
    for before in STATES:
        at, audit, cost = before, "", 0
        for _ in range(3):
            edits = [("D", at, DELETE_COST)]
            if symbol != DELETE:
                more = TRUNCATED_COST * symbol.isupper()
                edits.append(("R", NEXT[at, WANTED[at]], REROLE_COST + more))
                if (at, symbol.lower()) in NEXT:
                    edits.append(("K", NEXT[at, symbol.lower()], KEEP_COST + more))
            for edit, after, price in edits:
                out[before * 4 + after] = better(out[before * 4 + after], (cost + price, audit + edit))
            at, audit, cost = NEXT[at, WANTED[at]], audit + "I", cost + INSERT_COST
    return out


def times(x: Matrix, y: Matrix) -> Matrix:
    """Min-plus product: the audits of y after those of x."""
    out: Matrix = [None] * 16
    for i, k, j in product(STATES, STATES, STATES):
        a, b = x[i * 4 + k], y[k * 4 + j]
        if a and b and (out[i * 4 + j] is None or a[0] + b[0] <= out[i * 4 + j][0]):
            out[i * 4 + j] = better(out[i * 4 + j], (a[0] + b[0], (a[1], b[1])))
    return out


def grammar(sequences: DataFrame, rounds: int = ROUNDS, per_round: int = RULES_PER_ROUND) -> list[tuple[str, str]]:
    """(new symbol, pair) in order of making, from (seq): Re-Pair over all sequences at once.

    Equal sequences are one with a count. Every round counts all pairs of neighbours and replaces the most
    frequent ones that have no symbol in common; at most ``per_round`` pairs reach the driver in a round.
    """
    rules: list[tuple[str, str]] = []
    left = cut_lineage(sequences.groupBy("seq").agg(F.count("*").alias("n")))
    for _ in range(rounds):
        at = left.where(F.length("seq") > 1).select("seq", "n", F.explode(F.sequence(F.lit(1), F.length("seq") - 1)).alias("at"))
        pairs = at.groupBy(F.substring("seq", F.col("at"), F.lit(2)).alias("pair")).agg(F.sum("n").alias("n")).where("n > 1")
        used: set[str] = set()
        new = []
        for r in pairs.orderBy(F.desc("n"), "pair").limit(per_round).collect():
            if not used & set(r["pair"]):
                used |= set(r["pair"])
                new.append((chr(_FIRST_RULE + len(rules) + len(new)), r["pair"]))
        if not new:
            break
        rules += new
        short = F.col("seq")
        for symbol, pair in new:
            short = F.replace(short, F.lit(pair), F.lit(symbol))
        left = cut_lineage(left.select(short.alias("seq"), "n").groupBy("seq").agg(F.sum("n").alias("n")))
    return rules


class Transfer:
    """Matrices of the grammar's symbols, made bottom-up, and of whole sequences; the latest are remembered."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.rules = rules
        self.of = {c: row_matrix(c) for c in SOUND + SOUND.upper() + DELETE}
        for symbol, pair in rules:
            self.of[symbol] = times(self.of[pair[0]], self.of[pair[1]])
        self.seen: dict[str, tuple[list, list]] = {}

    def sequence(self, seq: str) -> tuple[list, list]:
        """Costs (None where there is no way) and audits, from state to state."""
        if seq not in self.seen:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            short = seq
            for symbol, pair in self.rules:
                short = short.replace(pair, symbol)
            m = self.of[short[0]]
            for c in short[1:]:
                m = times(m, self.of[c])
            self.seen[seq] = [e and e[0] for e in m], [e and flat(e[1]) for e in m]
        return self.seen[seq]


def way(chunks: list[tuple[list, list]]) -> Iterator[tuple[int, int, int]]:
    """(start, end, cost of all) for each chunk of a conversation, from (costs, order of the audits) of its chunks.

    Costs to the end are found backwards; forwards, of the ways that are cheapest in all the one with the least audit here.
    """
    to_end = [[INSERT_COST * len(TAIL[s]) for s in STATES]]
    for costs, _ in reversed(chunks):
        to_end.append([min(costs[i * 4 + j] + to_end[-1][j] for j in STATES if costs[i * 4 + j] is not None) for i in STATES])
    to_end.reverse()
    at, total = START, to_end[0][START]
    for (costs, order), now, then in zip(chunks, to_end, to_end[1:]):
        start = at
        fits = [j for j in STATES if costs[start * 4 + j] is not None and costs[start * 4 + j] + then[j] == now[start]]
        at = min(fits, key=lambda j: order[start * 4 + j])
        yield start, at, total


def applied(audit: str, roles: list, texts: list, at: int) -> tuple[list, list]:
    """Roles and texts after the edits of an audit, from a state."""
    out_roles, out_texts, row = [], [], 0
    for edit in audit:
        if edit == "D":
            row += 1
            continue
        role, text = ROLES[WANTED[at]], ""
        initial = role[0]
        if edit != "I":
            text = texts[row]
            if edit == "K":
                role = roles[row]
                initial = role[0]
            row += 1
        at = NEXT[at, initial]
        out_roles.append(role)
        out_texts.append(text)
    return out_roles, out_texts


def _conv(conv_id="conv_id"):
    return F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit("-"))


def damaged(convs: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that crc32 of ``conv_id:turn`` modulo 20 orders: 0 drops the row,
    1 empties its text, 2 takes ``.!?`` out of it, 3 repeats it, 4 makes its role ``user``; null is one blank."""
    blank = F.lit(" ")
    text_or = lambda c: F.coalesce(F.col(c).cast("string"), blank)
    how = F.crc32(F.concat(text_or("conv_id"), F.lit(":"), text_or("turn")).cast("binary")) % 20
    rows = convs.select("conv_id", "turn", text_or("role").alias("role"), text_or("text").alias("text"), how.alias("how")).where("how <> 0")
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("how") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def chunks(convs: DataFrame, rows_per_chunk: int = CHUNK_ROWS) -> DataFrame:
    """(conv, chunk, seq, roles, texts, counts) per piece of a conversation, stored; ``seq`` has one symbol per row.

    Rows stand by turn (nulls first), of one turn by role, beginning and hash of the text. That order is found by
    range over all rows, so a conversation of any length is dealt over many tasks.
    """
    initial = F.left(F.col("role"), F.lit(1))
    rows = cut_lineage(convs.select(
        _conv().alias("conv"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    ).select(
        "*", F.left(F.col("text"), F.lit(32)).alias("lead"), F.unhex(F.md5(F.concat_ws("|", F.length("conv"), "conv", F.length("role"), "role", "text").cast("binary"))).alias("k"),
        F.monotonically_increasing_id().alias("tie"), (F.btrim("text", F.lit(BLANKS)) == "").alias("is_blank"),
    ))
    firsts = rows.where("not is_blank").groupBy("k").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = hot_join(rows, firsts, "k").withColumn("later", F.coalesce(F.struct("turn") > F.col("first"), F.lit(False))).drop("first")
    rows = over_order(
        rows, ["conv"], ["turn", "role", "lead", "k", "tie"],
        rank("at"), lag("before", F.struct("turn", initial.alias("initial"), "k")),
    )
    b = F.col("before")
    fault = (
        F.when(F.col("is_blank"), "blank").when(F.col("later") | F.coalesce(b["k"] == F.col("k"), F.lit(False)), "duplicate")
        .when(~F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1)).isin(*ENDS), "truncated").otherwise("")
    )
    rows = rows.withColumn("fault", fault)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), DELETE).when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    count = lambda c, name: F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(name)
    new_turn = F.col("turn").isNotNull() & (b.isNull() | b["turn"].isNull() | (b["turn"] != F.col("turn")))
    parts = rows.groupBy("conv", F.floor((F.col("at") - 1) / rows_per_chunk).alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct("at", symbol.alias("symbol"), "role", "text"))).alias("rows"),
        F.min("turn").alias("low"), F.max("turn").alias("high"), count(new_turn, "turns"),
        *[count(F.col("fault") == f, f) for f in ("blank", "duplicate", "truncated")],
        count(b.isNotNull() & ~F.concat(b["initial"], initial).isin("su", "ua", "au"), "illegal"),
    )
    seq = F.array_join(F.col("rows.symbol"), "").alias("seq")
    return cut_lineage(parts.select(*[c for c in parts.columns if c != "rows"], seq, F.col("rows.role").alias("roles"), F.col("rows.text").alias("texts")))


def _whole(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple[str, list]]:
    """(conv, its rows) of sorted batches."""
    held, conv = [], None
    for pdf in batches:
        for row in zip(pdf["conv"], *[pdf[c] for c in columns]):
            if row[0] != conv and held:
                yield conv, held
                held = []
            conv = row[0]
            held.append(row[1:])
    if held:
        yield conv, held


def repair(convs: DataFrame, rows_per_chunk: int = CHUNK_ROWS) -> DataFrame:
    """(conv, chunk, audit, cost, repaired, ...) per piece of a conversation, stored: its cheapest repair.

    Every row is a symbol of its role (s, u, a, other) and first fault: blank, duplicate (role and text seen
    earlier) or truncated. Edits are Keep, Rerole, Delete and Insert; the roles after them are ``(s?(ua)+)?``.
    Sequences of symbols are compressed by one grammar for all conversations. Each of its rules has a 4 x 4
    matrix of the cheapest cost, and the least audit among the cheapest as a rope, from state to state; it is the
    min-plus product of the matrices of the rule's two symbols, made once. A piece's matrix is the product of the
    few symbols it is compressed to. Costs of the pieces of a conversation (16 numbers each) then meet to find
    the states between them.

    ``audit`` joins the initials of the edits of the piece, ``repaired`` the rows after them (role, text),
    ``cost`` is that of the conversation. Null role or text is one blank; null turns stand first; rows of one
    turn stand by role and text; a null conv_id is a conversation. An empty table gives no rows. Other columns
    are ignored.
    """
    parts = chunks(convs, rows_per_chunk)
    shared = convs.sparkSession.sparkContext.broadcast(grammar(parts.select("seq")))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        transfer = Transfer(shared.value)
        for pdf in batches:
            both = [transfer.sequence(s) for s in pdf["seq"]]
            order = [[-1 if a is None else sorted(x for x in audits if x is not None).index(a) for a in audits] for _, audits in both]
            yield pd.DataFrame({"conv": pdf["conv"], "chunk": pdf["chunk"], "costs": [[-1 if x is None else x for x in c] for c, _ in both], "order": order})

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for conv, rows in _whole(batches, ["chunk", "costs", "order"]):
            own = [([None if x < 0 else int(x) for x in c], list(o)) for _, c, o in rows]
            out += [(conv, r[0], start, end, cost, k == len(rows) - 1) for k, (r, (start, end, cost)) in enumerate(zip(rows, way(own)))]
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["conv", "chunk", "start", "end", "cost", "last"])
                out = []
        yield pd.DataFrame(out, columns=["conv", "chunk", "start", "end", "cost", "last"])

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        transfer = Transfer(shared.value)
        for pdf in batches:
            audits = [transfer.sequence(s)[1][i * 4 + j] + (TAIL[j] if z else "") for s, i, j, z in zip(pdf["seq"], pdf["start"], pdf["end"], pdf["last"])]
            both = [applied(a, r, t, s) for a, r, t, s in zip(audits, pdf["roles"], pdf["texts"], pdf["start"])]
            yield pd.DataFrame({
                "conv": pdf["conv"], "chunk": pdf["chunk"], "cost": pdf["cost"], "audit": audits, "repaired_roles": [b[0] for b in both], "repaired_texts": [b[1] for b in both],
            })

    costs = parts.select("conv", "chunk", "seq").mapInPandas(measure, "conv string, chunk long, costs array<long>, order array<int>")
    states = costs.repartition("conv").sortWithinPartitions("conv", "chunk").mapInPandas(choose, "conv string, chunk long, start int, end int, cost long, last boolean")
    met = parts.select("conv", "chunk", "seq", "roles", "texts").join(states, ["conv", "chunk"])
    done = met.mapInPandas(apply, "conv string, chunk long, cost long, audit string, repaired_roles array<string>, repaired_texts array<string>")
    stats = parts.drop("seq", "roles", "texts")
    return cut_lineage(done.withColumn("repaired", F.arrays_zip(F.col("repaired_roles").alias("role"), F.col("repaired_texts").alias("text"))).drop("repaired_roles", "repaired_texts").join(stats, ["conv", "chunk"]))


def turns(repaired: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, place, role, text) of the repaired conversations; ``place`` orders the rows of one."""
    kind = convs.schema["conv_id"].dataType
    rows = repaired.select("conv", "chunk", F.posexplode("repaired").alias("at", "r"))
    return rows.select(_id(kind), F.struct("chunk", "at").alias("place"), "r.role", "r.text")


def _id(kind):
    return F.when(F.col("conv") != "-", F.substring("conv", 2, 2**31 - 1)).cast(kind).alias("conv_id")


def report(convs: DataFrame, original: DataFrame | None = None, rows_per_chunk: int = CHUNK_ROWS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) per conversation.

    One row for every conv_id of ``original`` (of ``convs`` without it); one without rows has zeros, an empty audit
    and the hash of the empty text. The hash and the audit of a conversation need its rows one after the other:
    they go in pieces, in order, through one task that holds a piece at a time (and the audit).
    """
    done = repair(convs, rows_per_chunk)
    total = lambda c: F.sum(c).alias(c)
    gaps = F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns"), F.lit(0)).alias("gaps")
    stats = done.groupBy("conv").agg(gaps, *[total(c) for c in ("blank", "duplicate", "truncated", "illegal")], F.max("cost").alias("cost"))
    line = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    pieces = done.select("conv", "chunk", "audit", F.when(F.size("repaired") > 0, line).alias("lines"))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, audit, sha, first, out = None, [], None, True, []
        for pdf in batches:
            for c, a, lines in zip(pdf["conv"], pdf["audit"], pdf["lines"]):
                if c != conv:
                    if conv is not None:
                        out.append((conv, "".join(audit), sha.hexdigest()))
                    conv, audit, sha, first = c, [], hashlib.sha256(), True
                audit.append(a)
                if lines is not None:
                    sha.update(("" if first else "\n").encode() + lines.encode("utf-8", "surrogatepass"))
                    first = False
            yield pd.DataFrame(out, columns=["conv", "audit", "repaired_sha256"])
            out = []
        if conv is not None:
            out.append((conv, "".join(audit), sha.hexdigest()))
        yield pd.DataFrame(out, columns=["conv", "audit", "repaired_sha256"])

    texts = pieces.repartition("conv").sortWithinPartitions("conv", "chunk").mapInPandas(digest, "conv string, audit string, repaired_sha256 string")
    source = convs if original is None else original
    out = source.select(_conv().alias("conv")).distinct().join(stats, "conv", "left").join(texts, "conv", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(
        _id(source.schema["conv_id"].dataType), *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
