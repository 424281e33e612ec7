"""Versioned commands (M2 update, M3 soft delete, M4 restore) judged as if one after another, in expressions.

A command is a transition of its contact's (version, trashed): it fires where
the version is the expected one and the contact is where the kind needs it,
and leaves any other state alone. The commands of a contact in ``seq`` order
are cut into chunks of at most ``chain``; a fold over a chunk's array
(``aggregate``) judges its commands from the state in which the chunk begins.

* Nearly all contacts have one chunk, which begins with the snapshot.
* A contact with more has its chunks spread over tasks. What a chunk does to
  each state that it reacts to is a small map, made by folding the chunk from
  its end (``transitions``); the maps are composed over the chunks by pointer
  doubling (``entry_states``), so a chain of n chunks takes log n joins. Values
  of fields come from the last chunk that set them.

Whether a command changes nothing depends on field values, and whether an
e-mail is taken on the other contacts. Both are known only with the outcomes,
so chunks concerned are judged in rounds: each round folds them with what the
round before found, until nothing changes. After each round at least one more
command in ``seq`` order is final, so the rounds end with the serial outcome;
their number is the depth to which decisions hang on each other, not the
number of commands.

E-mails: an applied command that changes what an active contact holds releases
one e-mail and takes another. The takes and releases of an e-mail in ``seq``
order are its ownership intervals; a command that wants it is refused if the
latest one before it is a take by another contact. That lookup is dealt by
(e-mail, range of ``seq``), each range carrying on from the ranges before it,
so an e-mail that a third of all commands want is no hot task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolodeck.operators.ranking import position_within
from rolodeck.sources.staged import staged

# Editable columns and outcome codes.
FIELDS = ("first_name", "last_name", "email", "phone", "company")
APPLIED, NO_CHANGE, NOT_FOUND = "APPLIED", "NO_CHANGE", "NOT_FOUND"
IN_TRASH, CONFLICT, EMAIL_TAKEN = "CONTACT_DELETED", "VERSION_CONFLICT", "EMAIL_TAKEN"
ALREADY_DELETED, ALREADY_ACTIVE = "ALREADY_DELETED", "ALREADY_ACTIVE"

#: Commands of one contact in a row; commands of a range of ``seq`` in which an e-mail's takes and releases meet.
CHAIN, RANGE_ROWS = 256, 1 << 20

CONTACT = ["contact_id", "account_id"]
CHUNK = [*CONTACT, "chunk"]
_SEQS = "array<bigint>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.transform(F.array(value), body)[0]


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- chunks


def chunked(commands: DataFrame, longest: int, chain: int) -> DataFrame:
    """CHUNK and cmds: the commands of a contact in ``seq`` order, at most ``chain`` a row."""
    names = F.array_compact(F.array(*[F.when(F.col(f"{f}_set"), F.lit(i)) for i, f in enumerate(FIELDS)]))
    cmd = F.struct("seq", "kind", F.col("expected_version").cast("int").alias("expected"), F.array(*FIELDS).alias("values"), names.alias("sets"))
    rows = commands.select(*CONTACT, cmd.alias("cmd"))

    def collected(df: DataFrame) -> DataFrame:
        # dealt by a stated number, as folding is more work than the size of its input shows
        return df.repartition(_partitions(df), *CHUNK).groupBy(*CHUNK).agg(F.array_sort(F.collect_list("cmd")).alias("cmds"))

    short = rows.withColumn("chunk", F.lit(0).cast("long"))
    if longest <= chain:
        return collected(short)
    many = commands.groupBy(*CONTACT).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > chain).select(*CONTACT)
    placed = position_within(rows.join(many, CONTACT, "left_semi").withColumn("seq", F.col("cmd.seq")), CONTACT, [F.col("seq")])
    long = placed.withColumn("chunk", F.floor((F.col("pos") - 1) / chain)).drop("pos", "seq")
    return collected(short.join(many, CONTACT, "left_anti")).unionByName(collected(long))


# ---------------------------------------------------------------- fold of a chunk


EMAIL = FIELDS.index("email")


def _outcome(s: Column, c: Column, lost: Column, found: Column) -> Column:
    in_time = c["expected"].eqNullSafe(s["version"])
    changes = F.exists(c["sets"], lambda i: ~s["fields"][i].eqNullSafe(c["values"][i]))
    refused = F.array_contains(lost, c["seq"])
    active = F.when(~in_time, CONFLICT).when(c["kind"] == "delete", APPLIED).when(~changes, NO_CHANGE).when(refused, EMAIL_TAKEN).otherwise(APPLIED)
    trashed = F.when(c["kind"] == "update", IN_TRASH).when(c["kind"] == "delete", ALREADY_DELETED).when(~in_time, CONFLICT).when(refused, EMAIL_TAKEN).otherwise(APPLIED)
    return F.when(~found, NOT_FOUND).when(s["deleted"], trashed).when(c["kind"] == "restore", ALREADY_ACTIVE).otherwise(active)


def _folded(kept: str, kept_type: str, entries: Callable[[Column, Column, Column], Column]) -> Column:
    """Over a chunk's cmds, found, lost and state: the commands judged in order; ``entries`` (state, command, outcome) adds to the array ``kept``."""
    start = F.struct(*[F.col(f"state.{f}").alias(f) for f in ("version", "deleted", "fields")], F.array().cast(kept_type).alias(kept))

    def step(s: Column, c: Column) -> Column:
        def after(o: Column) -> Column:
            written = F.transform(s["fields"], lambda v, i: F.when(F.array_contains(c["sets"], i), c["values"][i]).otherwise(v))
            fired = F.struct((s["version"] + 1).alias("version"), F.when(c["kind"] == "update", s["deleted"]).otherwise(c["kind"] == "delete").alias("deleted"),
                             F.when(c["kind"] == "update", written).otherwise(s["fields"]).alias("fields"), F.concat(s[kept], entries(s, c, o)).alias(kept))
            idle = F.struct(s["version"].alias("version"), s["deleted"].alias("deleted"), s["fields"].alias("fields"), F.concat(s[kept], entries(s, c, o)).alias(kept))
            return F.when(o == APPLIED, fired).otherwise(idle)
        return _let(_outcome(s, c, F.col("lost"), F.col("found")), after)

    return F.aggregate("cmds", start, step)[kept]


def judged(chunks: DataFrame) -> DataFrame:
    """A row per command of ``chunks``: CHUNK, the command, outcome, version and deleted after it, and the fields before it (b_<field>)."""
    log = _folded("log", "array<struct<outcome:string,version:int,moved:boolean,was:boolean,before:array<string>>>", lambda s, c, o: F.array(F.struct(
        o.alias("outcome"), (s["version"] + (o == APPLIED).cast("int")).alias("version"), ((o == APPLIED) & (c["kind"] != "update")).cast("boolean").alias("moved"), s["deleted"].alias("was"), s["fields"].alias("before"))))
    each = chunks.select(*CHUNK, "cmds", log.alias("log")).select(*CHUNK, F.explode(F.arrays_zip("cmds", "log")).alias("x"))
    return each.select(
        *CHUNK, "x.cmds.seq", "x.cmds.kind", *[F.col("x.cmds.values")[i].alias(f) for i, f in enumerate(FIELDS)], *[F.array_contains("x.cmds.sets", i).alias(f"{f}_set") for i, f in enumerate(FIELDS)],
        "x.log.outcome", "x.log.version", (F.col("x.log.was") != F.col("x.log.moved")).alias("deleted"), *[F.col("x.log.before")[i].alias(f"b_{f}") for i, f in enumerate(FIELDS)])


# ---------------------------------------------------------------- e-mails

_MAIL = "array<struct<seq:bigint,email:string,is_claim:boolean,takes:boolean,refused:boolean>>"


def mail_events() -> Column:
    """Over a chunk: what its commands want (is_claim), release and take, in ``seq`` order, as an array."""
    def entries(s: Column, c: Column, o: Column) -> Column:
        fired, mine = o == APPLIED, s["fields"][EMAIL]
        names = (c["kind"] == "update") & F.array_contains(c["sets"], EMAIL)
        wants = F.when(c["kind"] == "restore", mine).when(names, c["values"][EMAIL])
        leaves = F.when(fired & ((c["kind"] == "delete") | (names & ~mine.eqNullSafe(c["values"][EMAIL]))), mine)

        def event(email: Column, is_claim: bool, takes: bool) -> Column:
            return F.when(email.isNotNull(), F.struct(c["seq"].alias("seq"), email.alias("email"), F.lit(is_claim).alias("is_claim"), F.lit(takes).alias("takes"), (o == EMAIL_TAKEN).alias("refused")))

        # a claim for what the contact holds already takes it once more, which changes nothing
        found = F.array(event(wants, True, False), event(leaves, False, False), event(F.when(fired, wants), False, True))
        return F.when(o.isin(APPLIED, EMAIL_TAKEN), F.array_compact(found)).otherwise(F.array().cast(_MAIL))

    return _folded("mail", _MAIL, entries)


def refusals(events: DataFrame, low: int, width: int | None) -> DataFrame:
    """CHUNK, lost (seqs of claims to an e-mail that another contact holds by then) and moved (these are not the ones that were refused).

    A claim is lost if the latest take or release before it is a take by another contact. ``events``: CHUNK and the members
    of ``mail_events``; ``low`` and ``width`` cut ``seq`` into ranges (None: one). A command's claim comes before what it takes.
    """
    key = ["account_id", "email"] if width is None else ["account_id", "email", "range"]
    dealt = events if width is None else events.withColumn("range", F.floor((F.greatest("seq", F.lit(low)) - low) / width))
    happened = F.when(~F.col("is_claim"), F.struct("contact_id", "takes"))
    within = Window.partitionBy(*key).orderBy("seq", F.col("is_claim").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owner = F.last(happened, ignorenulls=True).over(within)
    claims = dealt.withColumn("owner", owner).filter("is_claim")
    if width is not None:
        tails = dealt.groupBy(*key).agg(F.max_by(happened, F.when(~F.col("is_claim"), F.col("seq"))).alias("tail"))
        earlier = Window.partitionBy("account_id", "email").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
        claims = claims.join(tails.select(*key, F.last("tail", ignorenulls=True).over(earlier).alias("carried")), key).withColumn("owner", F.coalesce("owner", "carried"))
    lost = F.coalesce(F.col("owner.takes") & (F.col("owner.contact_id") != F.col("contact_id")), F.lit(False))
    return claims.withColumn("is_lost", lost).groupBy(*CHUNK).agg(F.collect_list(F.when(F.col("is_lost"), F.col("seq"))).alias("lost"), F.max(F.col("is_lost") != F.col("refused")).alias("moved"))


# ---------------------------------------------------------------- contacts of many chunks


def transitions(chunks: DataFrame) -> DataFrame:
    """(CHUNK, key, out): what a chunk makes of each state that it reacts to; a state is 2 * version + trashed.

    ``chunks``: CHUNK, cmds, lost, same (commands that change nothing). Folded from the end: a command sends its state
    to where the commands after it send the state that it leaves.
    """
    def back(m: Column, c: Column) -> Column:
        key = 2 * c["expected"].cast("long") + (c["kind"] == "restore").cast("long")
        left = 2 * c["expected"].cast("long") + 2 + (c["kind"] == "delete").cast("long")
        fires = c["expected"].isNotNull() & ~F.array_contains("lost", c["seq"]) & ~F.array_contains("same", c["seq"])
        to = F.coalesce(F.element_at(m, left), left)
        return F.when(fires, F.map_concat(F.map_filter(m, lambda k, _: k != key), F.create_map(key, to))).otherwise(m)

    table = F.aggregate(F.reverse("cmds"), F.create_map().cast("map<bigint,bigint>"), back)
    return chunks.select(*CHUNK, F.explode(table).alias("key", "out"))


def _visited(nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """The transitions that each contact passes, from its start state on, by pointer doubling."""
    ask = nodes.select(*CONTACT, "chunk", F.col("out").alias("state"), "key", "out", F.lit(True).alias("asks"))
    have = nodes.select(*CONTACT, "chunk", F.col("key").alias("state"), "key", "out", F.lit(False).alias("asks"))
    later = Window.partitionBy(*CONTACT, "state").orderBy("chunk", "asks").rowsBetween(1, Window.unboundedFollowing)  # chunks of one contact
    jumps = have.unionByName(ask).withColumn("to_chunk", F.first(F.when(~F.col("asks"), F.col("chunk")), ignorenulls=True).over(later)) \
        .filter("asks").select(*CHUNK, "key", F.col("out").alias("to_key"), "to_chunk").filter("to_chunk IS NOT NULL")
    jumps = staged(jumps, "jumps")
    first = nodes.join(starts, CONTACT).filter(F.col("key") == F.col("start")).groupBy(*CONTACT, "key").agg(F.min("chunk").alias("chunk"))
    seen = staged(first.select(*CHUNK, "key"), "seen")
    while not jumps.isEmpty():
        reached = seen.join(jumps, [*CHUNK, "key"]).select(*CONTACT, F.col("to_chunk").alias("chunk"), F.col("to_key").alias("key"))
        seen = staged(seen.unionByName(reached).distinct(), "seen")
        on = jumps.select(*CONTACT, F.col("chunk").alias("to_chunk"), F.col("key").alias("to_key"), F.col("to_chunk").alias("far_chunk"), F.col("to_key").alias("far_key"))
        jumps = staged(jumps.join(on, [*CONTACT, "to_chunk", "to_key"]).select(*CHUNK, "key", F.col("far_chunk").alias("to_chunk"), F.col("far_key").alias("to_key")), "jumps")
    return nodes.join(seen, [*CHUNK, "key"], "left_semi")


def entry_states(chunks: DataFrame, rows: DataFrame | None) -> DataFrame:
    """CHUNK and state, in which each chunk of ``chunks`` (with lost, same and snap) begins; ``rows``: judged in the last round."""
    start = (2 * F.col("snap.version") + F.col("snap.deleted").cast("long")).alias("start")
    passed = _visited(staged(transitions(chunks), "transitions"), chunks.filter("found AND chunk = 0").select(*CONTACT, start))
    wrote = F.lit(None).cast("array<struct<value:string>>")
    placed = chunks.select(*CHUNK, "snap", start).join(passed.select(*CHUNK, "out"), CHUNK, "left")
    if rows is not None:
        wrote_by = [F.max_by(F.struct(F.col(f).alias("value")), F.when(F.col(f"{f}_set"), F.col("seq"))).alias(f"w_{f}") for f in FIELDS]
        written = rows.filter((F.col("outcome") == APPLIED) & (F.col("kind") == "update")).groupBy(*CHUNK).agg(*wrote_by)
        placed = placed.join(written, CHUNK, "left")
    else:
        placed = placed.withColumns({f"w_{f}": wrote[0] for f in FIELDS})
    before = Window.partitionBy(*CONTACT).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row a chunk
    key = F.coalesce(F.last("out", ignorenulls=True).over(before), F.col("start"))
    last = {f: F.last(f"w_{f}", ignorenulls=True).over(before) for f in FIELDS}
    fields = F.array(*[F.when(last[f].isNotNull(), last[f]["value"]).otherwise(F.col("snap.fields")[i]) for i, f in enumerate(FIELDS)])
    return placed.select(*CHUNK, F.struct(F.shiftright(key, 1).cast("int").alias("version"), (key % 2 == 1).alias("deleted"), fields.alias("fields")).alias("state"))


# ---------------------------------------------------------------- rounds


def _with(chunks: DataFrame, lost: DataFrame | None, states: DataFrame | None) -> DataFrame:
    """``chunks`` with the commands that lost an e-mail and the states in which they begin (the snapshot where none is given)."""
    if lost is not None:
        chunks = chunks.join(lost.select(*CHUNK, "lost"), CHUNK, "left").withColumn("lost", F.coalesce("lost", F.array().cast(_SEQS)))
    else:
        chunks = chunks.withColumn("lost", F.array().cast(_SEQS))
    if states is None:
        return chunks.withColumn("state", F.col("snap"))
    return chunks.join(states, CHUNK, "left").withColumn("state", F.coalesce("state", "snap"))


def _digest(df: DataFrame) -> tuple:
    h = F.xxhash64(*df.columns)
    return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first())


def _named() -> Column:
    """E-mails that a chunk's contact has or might come to have."""
    wanted = F.transform("cmds", lambda c: F.when((c["kind"] == "update") & F.array_contains(c["sets"], EMAIL), c["values"][EMAIL]))
    return F.array_distinct(F.array_compact(F.array_append(wanted, F.col("snap.fields")[EMAIL])))


def _rivals(chunks: DataFrame, owners: DataFrame) -> DataFrame:
    """(account_id, email) that several contacts hold or might come to hold in the batch."""
    each = chunks.filter("found").select(*CONTACT, F.explode(_named()).alias("email"), F.lit(True).alias("asked")).unionByName(owners.select("account_id", "contact_id", "email", F.lit(False).alias("asked")))
    return each.groupBy("account_id", "email").agg(F.min("contact_id").alias("lo"), F.max("contact_id").alias("hi"), F.max("asked").alias("asked")).filter("asked AND lo < hi").select("account_id", "email")


def settle(commands: DataFrame, snapshot: DataFrame, chain: int = CHAIN, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All ``commands`` judged, a row each: contact_id, account_id, the command, outcome, version, deleted, b_<field>.

    ``commands``: seq (unique), contact_id, account_id, kind, expected_version, FIELDS and their ``_set``. ``snapshot``:
    contact_id, account_id, version, deleted, FIELDS; an active contact's e-mail is its account's only one.
    """
    sizes = commands.groupBy(*CONTACT).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("low"), F.max("seq").alias("high"))
    facts = sizes.agg(F.max("n").alias("n"), F.sum("n").alias("all"), F.min("low").alias("low"), F.max("high").alias("high")).first()
    longest, low, high = facts["n"] or 0, facts["low"] or 0, facts["high"] or 0
    ranges = -(-(facts["all"] or 0) // range_rows)
    width = -(-(high - low + 1) // ranges) if ranges > 1 else None

    snap = snapshot.select(*CONTACT, F.struct("version", "deleted", F.array(*FIELDS).alias("fields")).alias("snap"))
    # the snapshot grows with the contacts: merged, as its size in files says little of what a broadcast would hold
    chunks = staged(chunked(commands, longest, chain).join(snap.hint("merge"), CONTACT, "left").withColumn("found", F.col("snap").isNotNull()), "chunks")
    owners = snapshot.filter(~F.col("deleted") & F.col("email").isNotNull()).select("account_id", "contact_id", "email")
    rivals = staged(_rivals(chunks, owners), "rivals")
    long = None
    if longest > chain:
        long = staged(chunks.filter("found").join(chunks.filter("chunk > 0").select(*CONTACT).distinct(), CONTACT, "left_semi"), "long")
    if long is None and rivals.isEmpty():
        return judged(_with(chunks, None, None)).drop("chunk")

    held = owners.join(rivals, ["account_id", "email"], "left_semi").select("contact_id", "account_id", F.lit(0).cast("long").alias("chunk"), F.struct(
        F.lit(low - 1).cast("long").alias("seq"), "email", F.lit(False).alias("is_claim"), F.lit(True).alias("takes"), F.lit(False).alias("refused")).alias("e"))
    concerned = chunks.filter("found").select(*CONTACT, F.explode(_named()).alias("email")).join(rivals, ["account_id", "email"], "left_semi").select(*CONTACT)
    if long is not None:
        concerned = concerned.unionByName(long.select(*CONTACT))
    contest = staged(chunks.join(concerned.distinct(), CONTACT, "left_semi").repartition(_partitions(chunks), *CHUNK), "contest")
    held, mail = staged(held, "held"), mail_events()
    lost = states = None
    if long is not None:
        states = staged(entry_states(_with(long, None, None).withColumn("same", F.array().cast(_SEQS)), None), "states")
    while True:
        events = _with(contest, lost, states).select(*CHUNK, F.explode(mail).alias("e")).unionByName(held).select(*CHUNK, "e.*")
        now_lost = staged(refusals(events, low, width), "lost")
        settled = now_lost.filter("moved").isEmpty()
        if long is not None:
            rows = staged(judged(_with(long, lost, states)), "rows")
            same = rows.filter(F.col("outcome") == NO_CHANGE).groupBy(*CHUNK).agg(F.collect_list("seq").alias("same"))
            marked = _with(long, now_lost, None).join(same, CHUNK, "left").withColumn("same", F.coalesce("same", F.array().cast(_SEQS)))
            now = staged(entry_states(marked, rows), "states")
            settled &= _digest(now) == _digest(states)
            states = now
        lost = now_lost
        if settled:
            return judged(_with(chunks, lost, states)).drop("chunk")
