"""Operator 7, n-gram Jaccard join with a token-group matrix.

Documents are sets of word shingles. Two documents link when |A and B| * 100 >= percent * |A or B|, exactly.

1. Equal sets collapse to one representative, so copies cost nothing further.
2. Similar representatives are put into groups: those that share a minhash are compared with two of them (the one whose
   tokens are most common, and one by a hash), and what links is joined. A group is thus already one component. Groups
   only save work: whatever they miss is found in step 4.
3. The token-group matrix says which token occurs in which group. Large groups are cut into blocks of about BLOCK
   members, and a block's token union is one row.
4. Every representative of the smaller group of two queries the blocks of the larger. A block's overlap with the query
   bounds that with each member: a link needs ceil(percent / 100 * |Q|) common tokens, so among the query's rarest
   n - that + l tokens, l are in the block's, and the first of them stands early enough in both that the tokens after
   it can make up the overlap. Other blocks are never opened. For these the overlap with the whole union is taken, and
   only blocks that still qualify are opened and their members compared.
5. Components of all links; a set's documents share one.

Which tokens are rare is read from a table of token counts of fixed size, summed over all documents. It decides the
order of tokens only; the result is the same for any order. Texts are read again for the documents in candidate pairs;
a bit table of fixed size, with a bit for each such id, passes them and a few others.

A null or blank text has an empty set, which links with nothing. Equal ids are one node. A row with a null id has a
null component. Columns of the result's names are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.llm.components import connected_components
from tallyspark.llm.words import NOT_BLANK, mix, shingle_sets, slices, text_batches
from tallyspark.session import materialize, scratch

COUNTERS = 1 << 20
SLICES = 64
MINHASHES = 4
BLOCK = 32
ID_BITS = 1 << 23
NAME = ["name_a", "name_b", "n"]
_SEEDS = np.random.Generator(np.random.PCG64(7)).integers(1, 2**64, MINHASHES, dtype=np.uint64)


def token_counts(texts: DataFrame, size: int) -> np.ndarray:
    """How many documents have a token of each counter, over all documents. The table's size never grows."""
    def count(batches):
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            sets = [s for _, words in slices(batch.column(0), NOT_BLANK) for s in shingle_sets(words, size)]
            tokens = np.concatenate([np.zeros(0, np.uint64), *sets])
            counts += np.bincount((tokens % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        yield _parts(counts)

    return _sum_table(texts.mapInArrow(count, "part int, counts binary"), COUNTERS)


def id_bits(ids: DataFrame) -> np.ndarray:
    """A table of fixed size with a bit set for every id."""
    def mark(batches):
        marks = np.zeros(ID_BITS, bool)
        for batch in batches:
            marks[_id_bit(batch.column(0))] = True
        yield _parts(np.packbits(marks).astype(np.int64))

    return np.unpackbits((_sum_table(ids.mapInArrow(mark, "part int, counts binary"), ID_BITS // 8, np.bitwise_or))
                         .astype(np.uint8)).astype(bool)


def _id_bit(ids: pa.Array) -> np.ndarray:
    values = np.asarray(ids.fill_null(0)).astype(np.int64).view(np.uint64)
    return (mix(values) % np.uint64(ID_BITS)).astype(np.int64)


def _sum_table(partial: DataFrame, length: int, combine=np.add) -> np.ndarray:
    """The tables of all tasks in one, combined as streams: a task holds the parts that fall to it only."""
    def add(batches):
        sums = {}
        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = np.frombuffer(data, np.int64)
                sums[at] = combine(sums[at], values) if at in sums else values
        yield _batch_of(sums.items())

    total = np.zeros((SLICES, length // SLICES), np.int64)
    for row in partial.repartition(SLICES, "part").mapInArrow(add, "part int, counts binary").collect():
        total[row["part"]] = np.frombuffer(row["counts"], np.int64)
    return total.ravel()


def _parts(table: np.ndarray) -> pa.RecordBatch:
    return _batch_of((i, part) for i, part in enumerate(table.reshape(SLICES, -1)) if part.any())


def _batch_of(parts) -> pa.RecordBatch:
    parts = list(parts)
    return pa.RecordBatch.from_arrays(
        [pa.array([i for i, _ in parts], pa.int32()), pa.array([c.tobytes() for _, c in parts], pa.binary())],
        names=["part", "counts"])


def needed(n, percent: int):
    """Least overlap of a set of n tokens with any set it links with."""
    return -(-n * percent // 100)


def required(n, percent: int):
    """How many of the tokens in its prefix a set shares, at least, with any set it links with."""
    return np.minimum(needed(n, percent), 1 + n // 100)


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """Per document: id, n, two hashes that name the set, its rarest tokens (the prefix), rarest first, how common these
    are on the average, and the set's minhashes."""
    # Bounded by COUNTERS.
    counts = token_counts(docs.select(text_col), size)
    order = np.minimum(counts, 2**31 - 1).astype(np.uint32)

    def sign(batches):
        for batch in batches:
            ids = batch.column(0)
            n, names_a, names_b, prefixes, common, minima = [], [], [], [], [], []
            for _, words in slices(batch.column(1), NOT_BLANK):
                for tokens in shingle_sets(words, size):
                    k = len(tokens)
                    n.append(k)
                    names_a.append(np.add.reduce(tokens).astype(np.int64) if k else 0)
                    names_b.append(np.add.reduce(mix(tokens + _SEEDS[0])).astype(np.int64) if k else 0)
                    keep = int(k - needed(k, percent) + required(k, percent)) if k else 0
                    rare = order[(tokens % np.uint64(COUNTERS)).astype(np.int64)]
                    first = np.lexsort((tokens, rare))[:keep]
                    prefixes.append(tokens[first].astype(np.int64))
                    common.append(int(rare[first].mean()) if k else 0)
                    minima.append([mix(tokens + s).min().astype(np.int64) for s in _SEEDS] if k else [])
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(names_a, pa.int64()), pa.array(names_b, pa.int64()),
                 pa.array(prefixes, pa.list_(pa.int64())), pa.array(common, pa.int64()),
                 pa.array(minima, pa.list_(pa.int64()))],
                names=["id", "n", "name_a", "name_b", "prefix", "common", "minhash"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(
        sign, "id long, n long, name_a long, name_b long, prefix array<long>, common long, minhash array<long>")


def token_sets(texts: DataFrame, size: int, wanted: np.ndarray) -> DataFrame:
    """(id, tokens) of (id, text), for the ids whose bit is set in `wanted`."""
    packed = np.packbits(wanted)

    def sets(batches):
        chosen = np.unpackbits(packed).astype(bool)
        for batch in batches:
            batch = batch.filter(pa.array(chosen[_id_bit(batch.column(0))]))
            tokens = [t.astype(np.int64) for _, words in slices(batch.column(1), NOT_BLANK)
                      for t in shingle_sets(words, size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.list_(pa.int64()))],
                                             names=["id", "tokens"])

    return texts.mapInArrow(sets, "id long, tokens array<long>")


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 3,
                       percent: int = 90) -> DataFrame:
    """`docs` with `n_shingles` and `component_id`, the smallest id that links reach."""
    texts = text_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # Each step leaves its result only; what it stored on the way goes when it ends.
    with scratch(docs.sparkSession):
        named, classes, reps = _representatives(texts, size, percent)
        near = _near(texts, reps, size, percent)
        groups = _components(near, "groups")
        candidates = _block_candidates(reps, groups, percent)
        found = _open_blocks(candidates, classes, groups, texts, size, percent)
        whole = _components(near.union(found), "components")

        of_set = classes.join(whole, classes["rep"] == whole["node"], "left").select(
            *NAME, F.coalesce("component", "rep").alias("component"))
        # Equal ids with different texts are one node: the id's sets are joined by the id.
        return materialize(named.join(of_set, NAME, "left").select(
            "id", F.col("n").alias("n_shingles"),
            F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id")),
            "members", outlives=True)


def _representatives(texts: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The name of each document's set, the smallest id of each set, and the signatures of those."""
    with scratch(texts.sparkSession):
        signed = materialize(signatures(texts, "id", "text", size, percent), "signatures")
        named = materialize(signed.select("id", *NAME), "names", outlives=True)
        classes = materialize(
            named.filter("n > 0 AND id IS NOT NULL").groupBy(*NAME).agg(F.min("id").alias("rep")), "classes",
            outlives=True)
        reps = materialize(
            signed.join(classes.select(F.col("rep").alias("id"), *NAME), ["id", *NAME], "left_semi")
            .dropDuplicates(["id", *NAME]).select("id", "n", "prefix", "common", "minhash"), "representatives",
            outlives=True)
    return named, classes, reps


def _near(texts: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame:
    """The links among the pairs of `_first_of_key`."""
    with scratch(texts.sparkSession):
        alike = materialize(_first_of_key(reps, percent), "alike")
        return materialize(_linked(alike, _active_sets(texts, alike, size), percent), "near", outlives=True)


def _components(links: DataFrame, label: str) -> DataFrame:
    with scratch(links.sparkSession):
        return materialize(connected_components(links), label, outlives=True)


def _first_of_key(reps: DataFrame, percent: int) -> DataFrame:
    """Pairs of each representative with two of those that share a minhash and about the size."""
    step = np.log(100 / percent)
    keyed = reps.select("id", "n", "common", F.posexplode("minhash").alias("k", "h")).withColumn(
        "band", F.floor(F.log("n") / step + F.col("k") % 2 / 2.0))
    firsts = keyed.groupBy("k", "h", "band").agg(
        F.max(F.struct("common", "n", "id")).alias("middle"),
        F.min(F.struct(F.xxhash64("id").alias("x"), "n", "id")).alias("any"), F.count("*").alias("rows"),
    ).filter("rows > 1")
    pairs = keyed.join(firsts, ["k", "h", "band"]).select(
        "id", "n", F.explode(F.array(F.struct("middle.n", "middle.id"), F.struct("any.n", "any.id"))).alias("first"))
    return (
        pairs.filter(F.col("first.id") != F.col("id"))
        .filter(F.least("n", "first.n") * 100 >= F.greatest("n", "first.n") * percent)
        .select(F.least("id", "first.id").alias("a"), F.greatest("id", "first.id").alias("b")).distinct()
    )


def _active_sets(texts: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """Stored token sets of the documents in `pairs`, and of some others. Of equal ids with different texts, one."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
    return materialize(token_sets(texts, size, id_bits(ids)), "sets")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    left = sets.select(F.col("id").alias("a"), F.col("tokens").alias("left"))
    right = sets.select(F.col("id").alias("b"), F.col("tokens").alias("right"))
    both = F.size(F.array_intersect("left", "right"))
    return pairs.join(left, "a").join(right, "b").filter(
        both * 100 >= percent * (F.size("left") + F.size("right") - both)).select("a", "b")


def _grouped(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """`rows` with the group of their id."""
    placed = groups.select(F.col("node").alias("id"), "component")
    return rows.join(placed, "id", "left").withColumn("group", F.coalesce("component", "id")).drop("component")


def _blocked(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """`rows` with the size of their group and the block of their id."""
    sizes = groups.groupBy(F.col("component").alias("group")).agg(F.count("*").alias("group_size"))
    return rows.join(sizes, "group", "left").withColumn(
        "group_size", F.coalesce("group_size", F.lit(1))).withColumn(
        "block", F.pmod(F.xxhash64("id"), F.ceil(F.col("group_size") / BLOCK)).cast("int"))


def _block_candidates(reps: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(query, n, group, block): blocks of other groups that hold enough of a query's rare tokens."""
    with scratch(reps.sparkSession):
        return materialize(_met_blocks(_shared_postings(reps, groups), percent), "candidates", outlives=True)


def _shared_postings(reps: DataFrame, groups: DataFrame) -> DataFrame:
    """The rare tokens of each representative that occur in other groups too."""
    # Most tokens occur in one group only and go before the matrix is joined with the queries. All of them are dealt out
    # for that, so a row has no more than its place and group until then.
    token = Window.partitionBy("token")
    postings = _grouped(reps.select("id", "n", "prefix"), groups).select(
        "id", "n", "group", F.posexplode("prefix").alias("at", "token"))
    several = postings.withColumns({"low": F.min("group").over(token), "high": F.max("group").over(token)}).filter(
        "low <> high").drop("low", "high")
    return materialize(_blocked(several, groups), "matrix")


def _met_blocks(shared: DataFrame, percent: int) -> DataFrame:
    query = shared.select("token", F.col("id").alias("query"), F.col("n").alias("query_n"),
                          (F.col("n") - F.col("at")).alias("query_rest"),
                          F.struct(F.col("group_size").alias("s"), F.col("group").alias("g")).alias("query_rank"))
    matrix = shared.groupBy("token", "group", "group_size", "block").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("n") - F.col("at")).alias("rest"))
    # The i-th common token of two sets leaves at least their overlap less i - 1 in both.
    overlap = F.ceil((F.col("query_n") + F.col("least")) * percent / (100 + percent))
    rest = F.least("query_rest", "rest")
    fits = (
        (F.col("query_rank") < F.struct(F.col("group_size").alias("s"), F.col("group").alias("g")))
        & (F.col("most") * 100 >= F.col("query_n") * percent) & (F.col("query_n") * 100 >= F.col("least") * percent)
        & (rest >= overlap - _required("query_n", percent) + 1)
    )
    met = query.join(matrix, "token").filter(fits).groupBy("query", "query_n", "group", "block", "group_size").agg(
        F.count("*").alias("tokens"), F.min("least").alias("least"), F.max(rest).alias("rest"))
    return met.filter(
        (F.col("tokens") >= F.least(_required("query_n", percent), _required("least", percent)))
        & (F.col("rest") >= overlap)
    ).select("query", "query_n", "group", "block", "group_size")


def _required(column: str, percent: int):
    n = F.col(column)
    return F.least(F.ceil(n * percent / 100), 1 + F.floor(n / 100))


def _open_blocks(candidates: DataFrame, classes: DataFrame, groups: DataFrame, texts: DataFrame, size: int,
                 percent: int) -> DataFrame:
    """The links between queries and members of the candidate blocks."""
    with scratch(texts.sparkSession):
        blocks = candidates.select("group", "block").distinct()
        members = materialize(
            _blocked(_grouped(classes.select(F.col("rep").alias("id"), "n"), groups), groups)
            .join(blocks, ["group", "block"], "left_semi")
            .select("group", "block", F.col("id").alias("member"), F.col("n").alias("member_n")), "members")
        return materialize(_opened(candidates, members, texts, size, percent), "found", outlives=True)


def _opened(candidates: DataFrame, members: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    ends = candidates.select(F.col("query").alias("a"), F.col("query").alias("b")).union(
        members.select(F.col("member").alias("a"), F.col("member").alias("b")))
    sets = _active_sets(texts, ends, size)
    # A block has about BLOCK members whatever its group's size, so its union is one row.
    unions = members.join(sets, members["member"] == sets["id"]).groupBy("group", "block").agg(
        F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("union"), F.count("*").alias("n_members"),
        F.min("member").alias("only"))
    asked = candidates.join(sets, candidates["query"] == sets["id"]).join(unions, ["group", "block"])
    overlap = F.size(F.array_intersect("tokens", "union"))
    bounded = asked.select("query", "query_n", "group", "block", "n_members", "only",
                           overlap.cast("long").alias("overlap"), F.size("union").cast("long").alias("union_n"))
    qualified = materialize(
        bounded.filter(F.col("overlap") * 100 >= F.col("query_n") * percent), "qualified")
    # The union of a single member is its set: the overlap is exact, there is nothing to open.
    single = qualified.filter("n_members = 1").filter(
        F.col("overlap") * 100 >= percent * (F.col("query_n") + F.col("union_n") - F.col("overlap"))).select(
        F.col("query").alias("a"), F.col("only").alias("b"))
    opened = qualified.filter("n_members > 1").join(members, ["group", "block"]).filter(
        F.least("query_n", "member_n") * 100 >= F.greatest("query_n", "member_n") * percent)
    pairs = opened.select(F.col("query").alias("a"), F.col("member").alias("b")).distinct()
    return single.union(_linked(pairs, sets, percent))


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """One document of each component, the one with the smallest id; documents without an id stay.

    Rows with one id and different texts are documents of their own, named by a hash of both; of those in one component
    the least hash stays. Of rows with one id and one text, the one with the least hash of all columns stays.
    """
    text_col = options.get("text_col", "text")
    known = docs.filter(F.col(id_col).isNotNull())
    often = known.groupBy(id_col).agg(F.count("*").alias("often")).filter("often > 1").select(id_col)
    repeated = materialize(often, "repeated-ids")
    if repeated.isEmpty():
        found = jaccard_components(docs.select(id_col, text_col), id_col=id_col, **options)
        later = found.filter("id <> component_id").select(F.col("id").alias(id_col))
        return docs.join(later, id_col, "left_anti").select(*docs.columns)
    rows = docs.join(repeated.withColumn("_again", F.lit(True)), id_col, "left").withColumn(
        "_node", F.when(F.col("_again"), F.xxhash64(id_col, text_col)).otherwise(F.col(id_col).cast("long")))
    found = jaccard_components(rows.select("_node", text_col), id_col="_node", **options)
    components = found.filter("id is not null").select(F.col("id").alias("_node"), "component_id").distinct()
    names = rows.filter("_node is not null").select("_node", F.col(id_col).alias("_id")).distinct()
    first = names.join(components, "_node").groupBy("component_id").agg(
        F.min(F.struct("_id", "_node")).alias("first")).select("first._node")
    stay = rows.join(first, "_node", "left_semi")
    of_repeated = stay.filter("_again").groupBy("_node").agg(
        F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row")).select("row.*")
    single = stay.filter("_again is null").select(*docs.columns)
    return single.union(of_repeated).union(docs.filter(F.col(id_col).isNull()))
