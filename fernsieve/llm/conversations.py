"""The trie of conversation prefixes: what conversations share, counted once.

Every prefix of a conversation has a digest that is a running sum over its turns, so it is found without gathering a
conversation anywhere. A prefix is owned by the smallest conversation that begins with it; a conversation owns all its
prefixes from some depth on, its chain. That depth is found by binary search, all conversations at once, each step two
joins: to the digest at the middle depth and to the smallest conversation with that digest. Chains hang on the prefix
before their first, which makes them a tree; each is summed from its end upwards, and its total is added to all prefixes
above it, which are those of its own conversation that it does not own, in one aggregation by digest instead of one
join for each level of the tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernsieve.llm.common import n_words, running_sums, table
from fernsieve.plans.staging import drop_staged, let_workers_import, sent_if_few, stage_table

#: Ids that are joined to one text at most before texts of one prefix are hashed in order.
IDS_A_PIECE = 4096
#: Hash of no id.
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def number_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, place (from 1), digest (of role and text) and words of each turn, in order of ``turn``, null first.

    A null role or text counts as empty. Turns of equal number stand in order of their digest; rows that repeat are all
    turns. Rows with a null conversation belong to none and are left out. Other columns are not read.
    """
    said, by = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    digest = F.md5(F.concat(F.length(by).cast("string"), F.lit(":"), by, said).cast("binary"))
    turns = rows.where(F.col(conv).isNotNull()).select(F.col(conv).cast("bigint").alias("conv"), F.col(turn).alias("turn"), digest.alias("digest"), n_words(said).alias("words"))
    return running_sums(turns, "conv", ["turn", "digest"], {"place": F.lit(1).cast("bigint")}, "turns").select("conv", "place", "digest", "words")


def prefixes_of(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, depth, key, words, n) of every prefix of ``turns(conv, place, digest, words)``, the empty one included.

    ``convs(conv, n)`` has all conversations with their numbers of turns. ``key`` is 16 bytes: turns tagged with their
    places have 120-bit digests, whose sums up to a place are hashed again with the place.
    """
    tagged = F.md5(F.concat_ws(":", F.col("place").cast("string"), F.col("digest")).cast("binary"))
    half = lambda at: F.conv(F.substring("tag", at, 15), 16, 10).cast("decimal(20,0)")
    rows = turns.select("conv", F.col("place").alias("depth"), "words", tagged.alias("tag")).unionByName(convs.select("conv", F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("words"), F.lit("0" * 32).alias("tag")))
    summed = running_sums(rows, "conv", ["depth"], {"a": half(1), "b": half(16)}, "tags")
    key = F.unhex(F.md5(F.concat_ws(",", F.col("depth").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")).cast("binary")))
    return summed.select("conv", "depth", key.alias("key"), "words").join(sent_if_few(convs.select("conv", "n")), "conv")


def first_owned(prefixes: DataFrame, minima: DataFrame, convs: DataFrame) -> DataFrame:
    """Binary search, for all conversations at once, of the first depth whose prefix each owns; n + 1 if it owns none.

    Adds first, and parent, the owner of the prefix before it (null for the root's chain and where none is owned).
    """
    owners, at = minima.select(F.col("key").alias("_key"), "owner"), prefixes.select("conv", F.col("depth").alias("_depth"), "key")
    owners = sent_if_few(owners)
    state = stage_table(convs.select("conv", "n", F.lit(0).cast("bigint").alias("lo"), (F.col("n") + 1).alias("hi")), "search")

    def owner_at(probes: DataFrame, depth: Column) -> DataFrame:
        keyed = probes.withColumn("_at", depth).join(at.withColumnRenamed("conv", "_conv"), (F.col("conv") == F.col("_conv")) & (F.col("_at") == F.col("_depth"))).drop("_conv", "_depth")
        return keyed.join(owners, F.col("key") == F.col("_key")).drop("key", "_key")

    while True:
        open_ = state.where("lo < hi")
        if open_.isEmpty():
            break
        asked = owner_at(open_, F.floor((F.col("lo") + F.col("hi")) / 2).cast("bigint"))
        mine = F.col("owner") == F.col("conv")
        moved = asked.select("conv", "n", F.when(mine, F.col("lo")).otherwise(F.col("_at") + 1).alias("lo"), F.when(mine, F.col("_at")).otherwise(F.col("hi")).alias("hi"))
        # the middle of lo and n + 1 is n at most, so every probe finds its prefix
        before, state = state, stage_table(moved.unionByName(state.where("lo >= hi")), "search")
        drop_staged(before)
    found = state.select("conv", "n", F.col("lo").alias("first"))
    hung = owner_at(found.where("first > 0 AND first <= n"), F.col("first") - 1).select("conv", "n", "first", F.col("owner").alias("parent"))
    return stage_table(hung.unionByName(found.where("first = 0 OR first > n").withColumn("parent", F.lit(None).cast("bigint"))), "chains")


def hashed_ids(ids: DataFrame) -> DataFrame:
    """(key, ends_sha256) of ``ids(key, conv)``: SHA-256 of each key's ids, ascending, joined by commas.

    Ids of a key are first joined to texts of IDS_A_PIECE ids at most, by many tasks; SHA-256 takes bytes in order, so
    the texts of one key then stream, sorted, through one task that holds a batch of them and a digest.
    """
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    pieces = ids.groupBy("key", F.floor(F.col("conv") / IDS_A_PIECE).alias("piece")).agg(joined.alias("ids"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []

        def rows(done: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([h for _, h in done], pa.string())], names=["key", "ends_sha256"])

        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != key:
                    if state is not None:
                        out.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            if out:
                yield rows(out)
                out = []
        if state is not None:
            yield rows([(key, state.hexdigest())])

    let_workers_import(ids.sparkSession)
    return pieces.repartition("key").sortWithinPartitions("key", "piece").select("key", "ids").mapInArrow(work, "key binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each distinct prefix of the conversations ``convs(conv, n)`` with ``turns(conv, place, digest, words)``.

    conv_id (the smallest member), depth, parent_conv_id (null for the root), n_convs (members), n_children, n_leaves and
    saved_tokens of the subtree, ends_sha256. Places count from 1 without gaps up to n; ids are distinct and not null.
    Conversations without turns are members of the root only; without conversations there is no root.
    """
    convs = stage_table(convs, "convs")
    prefixes = stage_table(prefixes_of(turns, convs), "prefixes")
    minima = stage_table(prefixes.groupBy("key", "depth").agg(F.min("conv").alias("owner"), F.count("*").alias("n_convs"), F.max("words").alias("words")), "minima")
    chains = first_owned(prefixes, minima, convs)
    branches = chains.where("parent IS NOT NULL").groupBy(F.col("parent").alias("_owner"), (F.col("first") - 1).alias("_depth")).agg(F.count("*").alias("branches"))
    owned = minima.join(sent_if_few(chains.where("first <= n")), F.col("owner") == F.col("conv")).drop("conv")
    hung = owned.join(branches, (F.col("owner") == F.col("_owner")) & (F.col("depth") == F.col("_depth")), "left")
    n_children = (F.col("depth") < F.col("n")).cast("bigint") + F.coalesce("branches", F.lit(0))
    nodes = hung.select(
        "key", F.col("owner").alias("conv"), "depth", "n_convs", n_children.alias("n_children"), "first", (F.col("n") - F.col("depth")).alias("above"),
        F.when(F.col("depth") > F.col("first"), F.col("owner")).otherwise(F.col("parent")).alias("parent_conv_id"),
        (n_children == 0).cast("bigint").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
    )
    summed = stage_table(running_sums(nodes, "conv", ["above"], {"leaves": F.col("leaf"), "spared": F.col("saved")}, "nodes"), "sums")
    totals = stage_table(summed.where("depth = first").select("conv", F.col("leaves").alias("l"), F.col("spared").alias("s"), "first"), "totals")
    below = prefixes.join(sent_if_few(totals), "conv").where("depth < first").groupBy(F.col("key").alias("_below")).agg(F.sum("l").alias("l"), F.sum("s").alias("s"))
    ends = hashed_ids(prefixes.where("depth = n").select("key", "conv")).withColumnRenamed("key", "_ends")
    whole = summed.join(below, F.col("key") == F.col("_below"), "left").join(ends, F.col("key") == F.col("_ends"), "left")
    zero = F.lit(0).cast("bigint")
    return whole.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaves") + F.coalesce("l", zero)).alias("n_leaves"),
        (F.col("spared") + F.coalesce("s", zero)).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )


def trie_of(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The prefix trie of conversations as they are; see ``number_turns`` for nulls and ties and ``prefix_trie`` for the result."""
    turns = stage_table(number_turns(rows, conv, turn, role, text), "places")
    return prefix_trie(turns, turns.groupBy("conv").agg(F.count("*").alias("n")))


def with_shared_heads(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on their group's first: turns(conv, place, digest, words) and convs(conv, n).

    Conversation c gets the first h turns of conversation c - c % every (all if fewer, none if absent), then its own
    after its first h, where h is the CRC-32 of its decimal id modulo ``most``.
    """
    h = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % most
    counted = stage_table(turns.groupBy("conv").agg(F.count("*").alias("own")), "counted")
    groups = counted.select("conv", "own", h("conv").alias("h"), (F.col("conv") - F.col("conv") % every).alias("base"))
    shared = F.least(F.col("h"), F.coalesce(F.col("there"), F.lit(0)))
    convs = groups.join(counted.select(F.col("conv").alias("base"), F.col("own").alias("there")), "base", "left").select("conv", "base", "h", shared.alias("shared"), (shared + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"))
    convs = stage_table(convs, "rebuilt")
    heads = turns.where(F.col("place") < most).withColumnRenamed("conv", "base").join(convs.where("h > 0"), "base").where("place <= h").select("conv", "place", "digest", "words")
    tails = turns.join(sent_if_few(convs), "conv").where("place > h").select("conv", (F.col("place") - F.col("h") + F.col("shared")).alias("place"), "digest", "words")
    return heads.unionByName(tails), convs.select("conv", "n")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all ``conversations``, rebuilt on shared heads."""
    turns = stage_table(number_turns(table(spark, sf_dir, "conversations")), "places")
    return prefix_trie(*with_shared_heads(turns))


ORACLE_SQL = r"""
WITH o AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT c, c - c % 20 AS base, list_reduce(list_prepend(4294967295, list_transform(range(8 * length(c::VARCHAR)), lambda j:
      CASE WHEN j % 8 = 0 THEN ascii(substr(c::VARCHAR, j // 8 + 1, 1))::BIGINT ELSE 0 END)),
    lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))) AS inverted
  FROM (SELECT DISTINCT c FROM o)),
hs AS (SELECT c, base, xor(inverted, 4294967295) % 4 AS h FROM ids),
r AS (
  SELECT hs.c, 0 AS part, place, role, text FROM hs JOIN o ON o.c = hs.base AND o.place <= hs.h
  UNION ALL SELECT hs.c, 1, place, role, text FROM hs JOIN o ON o.c = hs.c AND o.place > hs.h),
p AS (
  SELECT c, row_number() OVER w AS depth, sha256(string_agg(md5(length(role) || ':' || role || text), ',') OVER w) AS k,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM r WINDOW w AS (PARTITION BY c ORDER BY part, place ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT c, 0, 'root', 0 FROM hs),
m AS (SELECT depth, k, min(c) AS conv_id, count(*) AS n_convs, max(words) AS words FROM p GROUP BY depth, k),
par AS (
  SELECT DISTINCT a.depth, a.k, b.k AS parent_k FROM p AS a JOIN p AS b ON a.c = b.c AND b.depth = a.depth - 1),
kids AS (SELECT depth - 1 AS depth, parent_k AS k, count(*) AS n_children FROM par GROUP BY ALL),
v AS (
  SELECT m.*, coalesce(n_children, 0) AS n_children, (m.n_convs - 1) * m.words AS saved FROM m LEFT JOIN kids USING (depth, k)),
pairs AS (SELECT DISTINCT a.depth, a.k, b.depth AS d2, b.k AS k2 FROM p AS a JOIN p AS b ON a.c = b.c AND a.depth <= b.depth),
sub AS (
  SELECT pairs.depth, pairs.k, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM pairs JOIN v ON v.depth = pairs.d2 AND v.k = pairs.k2 GROUP BY ALL),
fin AS (SELECT c, max(depth) AS depth, max_by(k, depth) AS k FROM p GROUP BY c),
ends AS (SELECT depth, k, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends FROM fin GROUP BY ALL)
SELECT v.conv_id, v.depth::BIGINT AS depth, mp.conv_id AS parent_conv_id, v.n_convs, v.n_children::BIGINT AS n_children, n_leaves, saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM v JOIN sub USING (depth, k) LEFT JOIN ends USING (depth, k) LEFT JOIN par ON par.depth = v.depth AND par.k = v.k
LEFT JOIN m AS mp ON mp.depth = v.depth - 1 AND mp.k = par.parent_k
"""
