"""Set computations over a log replicated on several nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvlume.schemas import APPEND_LIMIT, RETAINED_ENTRIES


def last_entries(log: DataFrame) -> DataFrame:
    """Entries, last index and last term of each node."""
    return log.groupBy("node_id").agg(F.count(F.lit(1)).alias("size"), F.max("index").alias("last_index"), F.max_by("term", "index").alias("last_term"))


def term_at(log: DataFrame, probes: DataFrame) -> DataFrame:
    """Probes (node_id, index) with the entry's term, 0 where there is none."""
    return probes.join(log.select("node_id", "index", "term"), ["node_id", "index"], "left").select("node_id", "index", F.coalesce("term", F.lit(0).cast("long")).alias("term"))


def truncate_from(log: DataFrame, index: int) -> DataFrame:
    return log.where(F.col("index") < index)


def compact_before(log: DataFrame, index: int) -> DataFrame:
    return log.where(F.col("index") >= index)


def entry_range(log: DataFrame, start: int, limit: int = 500) -> DataFrame:
    """The first ``limit`` entries of each node from ``start`` on."""
    in_order = Window.partitionBy("node_id").orderBy("index")
    return log.where(F.col("index") >= start).withColumn("_r", F.row_number().over(in_order)).where(F.col("_r") <= limit).drop("_r")


def matches_at(log: DataFrame, probes: DataFrame) -> DataFrame:
    """Whether each probe (node_id, index, term) agrees with the log. Index 0
    and entries that the log doesn't hold agree."""
    mine = log.select("node_id", "index", F.col("term").alias("_t"))
    ok = (F.col("index") == 0) | F.col("_t").isNull() | F.coalesce(F.col("_t") == F.col("term"), F.lit(False))
    return probes.join(mine, ["node_id", "index"], "left").select("node_id", "index", "term", ok.alias("matches"))


def state_after(changes: DataFrame) -> DataFrame:
    """Current term and vote from changes (node_id, seq, term, vote): the vote is
    the newest one of the newest term; a higher term clears it."""
    return changes.groupBy("node_id").agg(F.max("term").alias("current_term"), F.max_by("vote", F.when(F.col("vote").isNotNull(), F.struct("term", "seq"))).alias("_v"), F.max(F.when(F.col("vote").isNotNull(), F.col("term"))).alias("_vt")).select("node_id", "current_term", F.when(F.col("_vt") == F.col("current_term"), F.col("_v")).alias("voted_for"))


def propose(log: DataFrame, commands: DataFrame, leader: int, term: int) -> DataFrame:
    """Commands (place, command) as new entries after the leader's last index."""
    last = log.where(F.col("node_id") == leader).agg(F.coalesce(F.max("index"), F.lit(0)).alias("_last"))
    return commands.join(F.broadcast(last)).select(F.lit(leader).alias("node_id"), F.lit(term).cast("long").alias("term"), (F.col("_last") + F.col("place")).alias("index"), "command")


def up_to_date(term: Column, index: Column, my_term: Column, my_index: Column) -> Column:
    """A candidate's log is at least as new: later term, then longer log."""
    return F.struct(term, index) >= F.struct(my_term, my_index)


def grant_votes(candidates: DataFrame, voters: DataFrame) -> DataFrame:
    """Answers of voters (node_id, current_term, voted_for, last_index, last_term)
    to candidates (candidate, term, last_index, last_term). The pairs are nodes
    of one cluster, a handful; a vote once given in a term stays."""
    c = candidates.select("candidate", F.col("term"), F.col("last_index").alias("_ci"), F.col("last_term").alias("_ct"))
    free = (F.col("term") > F.col("current_term")) | F.col("voted_for").isNull() | (F.col("voted_for") == F.col("candidate"))
    ok = (F.col("term") >= F.col("current_term")) & free & up_to_date(F.col("_ct").alias("t"), F.col("_ci").alias("i"), F.col("last_term").alias("t"), F.col("last_index").alias("i"))
    return F.broadcast(c).join(voters, F.col("candidate") != F.col("node_id")).select("candidate", "node_id", "term", ok.alias("granted"))


def winners(votes: DataFrame, nodes: int) -> DataFrame:
    """Candidates with a majority of all nodes, their own vote included."""
    n = (F.count_if("granted") + 1).alias("votes")
    return votes.groupBy("term", "candidate").agg(n).where(F.col("votes") >= nodes // 2 + 1)


def conflicts(log: DataFrame, leader: int) -> DataFrame:
    """Per follower: the first index where terms differ (null if none), and the
    entries it lacks or must replace."""
    lead = log.where(F.col("node_id") == leader).select("index", F.col("term").alias("_lt"))
    others = log.where(F.col("node_id") != leader)
    first = others.join(lead, "index").where(F.col("term") != F.col("_lt")).groupBy("node_id").agg(F.min("index").alias("first_conflict"))
    top = lead.agg(F.max("index").alias("leader_last"))
    ends = others.groupBy("node_id").agg(F.max("index").alias("last_index")).join(first, "node_id", "left").join(F.broadcast(top))
    keep = F.least(F.coalesce(F.col("first_conflict") - 1, F.col("last_index")), F.col("leader_last"))
    return ends.select("node_id", "first_conflict", keep.alias("match_index"), (F.col("leader_last") - keep).alias("to_append"))


def append_batches(log: DataFrame, peers: DataFrame, leader: int, limit: int = APPEND_LIMIT) -> DataFrame:
    """What a heartbeat sends: of the leader's log from each peer's next_index
    on, at most ``limit`` entries. Indexes have no gaps, so the range is closed
    and needs no rank."""
    lead = log.where(F.col("node_id") == leader).select("term", "index", "command")
    p = F.broadcast(peers.select("peer", "next_index"))
    return lead.join(p, (F.col("index") >= F.col("next_index")) & (F.col("index") < F.col("next_index") + limit)).select("peer", "index", "term", "command")


def commit_index(log: DataFrame, match: DataFrame, leader: int, nodes: int) -> DataFrame:
    """The last entry of the leader's newest term that a majority holds: the
    order statistic of the match indexes, the leader's own included."""
    lead = log.where(F.col("node_id") == leader)
    term = lead.agg(F.max("term").alias("_term"))
    held = F.sort_array(F.collect_list("match_index"), asc=False)
    quorum = match.agg(F.element_at(held, nodes // 2 + 1).alias("_q"))
    reach = lead.join(F.broadcast(quorum.join(F.broadcast(term)))).where((F.col("index") <= F.col("_q")) & (F.col("term") == F.col("_term")))
    return reach.agg(F.coalesce(F.max("index"), F.lit(0).cast("long")).alias("commit_index"))


def apply(entries: DataFrame) -> DataFrame:
    """Commands as writes (seq, key, op, value): ``PUT key rest`` and ``DEL key``;
    all others are ignored."""
    part = lambda i: F.regexp_extract("command", r"^\s*(\S+)\s+(\S+)\s*([\s\S]*)$", i)
    out = entries.select(F.col("index").alias("seq"), part(2).alias("key"), part(1).alias("op"), part(3).alias("value"))
    return out.where(F.col("op").isin("PUT", "DEL")).withColumn("value", F.when(F.col("op") == "PUT", F.col("value")))


def append_entries(log: DataFrame, requests: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The logs after one request to each follower, and the replies.

    ``requests``: node_id, term, prev_index, prev_term, leader_commit, and what the
    follower has: current_term and commit_index. ``entries``: node_id, index, term,
    command. A request of an older term, or whose previous entry differs, changes
    nothing. Else the log ends before the first entry that differs, and entries
    past its end are added. Requests are one a node, so they are broadcast.
    """
    previous = log.select("node_id", F.col("index").alias("prev_index"), F.col("term").alias("_t"))
    fits = (F.col("prev_index") == 0) | F.col("_t").isNull() | (F.col("_t") == F.col("prev_term"))
    judged = requests.join(previous, ["node_id", "prev_index"], "left").withColumn("success", (F.col("term") >= F.col("current_term")) & fits)
    asked = F.broadcast(judged.where("success").select("node_id"))
    sent = entries.join(asked, "node_id", "left_semi")
    first = sent.join(log.select("node_id", "index", F.col("term").alias("_t")), ["node_id", "index"]).where(F.col("term") != F.col("_t")).groupBy("node_id").agg(F.min("index").alias("_first"))
    kept = log.join(F.broadcast(first), "node_id", "left").where(F.col("_first").isNull() | (F.col("index") < F.col("_first"))).drop("_first")
    last = kept.groupBy("node_id").agg(F.max("index").alias("_last"))
    added = sent.join(F.broadcast(last), "node_id", "left").where(F.col("index") > F.coalesce("_last", F.lit(0))).select(*log.columns)
    after = kept.unionByName(added)
    ends = after.groupBy("node_id").agg(F.max("index").alias("_end"), F.count(F.lit(1)).alias("log_size"))
    end = F.coalesce("_end", F.lit(0).cast("long"))
    commit = F.when(F.col("success") & (F.col("leader_commit") > F.col("commit_index")), F.least("leader_commit", end)).otherwise(F.col("commit_index"))
    replies = judged.join(ends, "node_id", "left").select("node_id", "success", F.when(F.col("success"), end).otherwise(0).alias("match_index"), commit.alias("commit_index"), F.coalesce("log_size", F.lit(0).cast("long")).alias("log_size"))
    return after, replies


def apply_committed(log: DataFrame, node: int, applied: int, commit: DataFrame) -> DataFrame:
    """Live keys after the entries in (applied, commit_index]; ``commit`` has one row."""
    from kvlume.operators.versions import latest

    own = log.where((F.col("node_id") == node) & (F.col("index") > applied)).join(F.broadcast(commit.select("commit_index")))
    return latest(apply(own.where(F.col("index") <= F.col("commit_index")).drop("commit_index")))


def retain(log: DataFrame, applied: DataFrame, keep: int = RETAINED_ENTRIES) -> DataFrame:
    """The newest ``keep`` applied entries and all later ones; ``applied`` has one
    row, commit_index."""
    return log.join(F.broadcast(applied.select("commit_index"))).where(F.col("index") > F.col("commit_index") - keep).drop("commit_index")


def node_states(log: DataFrame, leader: int, commit: DataFrame) -> DataFrame:
    """Introspection: role, term, commit index, applied index and log size."""
    out = last_entries(log).join(F.broadcast(commit))
    seen = F.least("last_index", "commit_index")
    return out.select("node_id", F.when(F.col("node_id") == leader, "Leader").otherwise("Follower").alias("role"), F.col("last_term").alias("term"), seen.alias("commit_index"), seen.alias("last_applied"), F.col("size").alias("log_size"), F.lit(leader).alias("leader_id"))
