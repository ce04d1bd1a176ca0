"""Problem 7: splits that keep related rows together.

Rows are linked by author (aliases are one author), campaign and equal cleaned text. Components are
found on the graph of these keys, not of the rows: every round each key hooks to one neighbour, and
the edges are contracted; a hub with a third of all edges only ever takes part in partial minima.
The neighbour is the one with the least hash of the round, so whatever the keys a share of them goes
with every round, and the number of rounds follows the logarithm of theirs. Keys are told apart by 123 bits.
The components' label vectors then go through grouped iterative stratification: components with the
rarest outstanding label first, into the split that needs that label most. Large components are placed
one by one; small ones of the same vector take their turn together and are told apart by their seeded rank.

Defined results: null, empty and blank keys link nothing; a row without keys is its own component;
ties go to the smallest ``row_id``; further columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paigham.llm.common import has_text
from paigham.storage import cut, drop_cut

LABELS = ("Scam", "Genuine")
#: Components above a LARGE-th of all rows are placed one by one; there are fewer than LARGE.
LARGE = 1000
#: Rows of one salt of the seeded ranks.
SALT_ROWS = 10_000


#: Splits that a plan may have.
MOST_SPLITS = 1000


def _key(kind: str, c: Column) -> Column:
    """A decimal of fixed width, which aggregates by hash as a number does: 64 bits of one hash and 18 digits of another."""
    high = F.xxhash64(F.lit(kind), c).cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)")
    return (high + F.pmod(F.xxhash64(F.lit(0x5EED), F.lit(kind), c), F.lit(10**18)).cast("decimal(18,0)")).cast("decimal(38,0)")


def keys_of(df: DataFrame) -> DataFrame:
    """``(row_id, s, c, t)``: hashed keys of each row, null where it has none."""
    return df.select(
        "row_id",
        F.when(F.col("sender_id").isNotNull(), _key("sender", F.col("sender_id").cast("string"))).alias("s"),
        F.when(has_text(F.col("campaign_id")), _key("campaign", F.col("campaign_id"))).alias("c"),
        F.when(has_text(F.col("cleaned_msg")), _key("text", F.col("cleaned_msg"))).alias("t"),
    )


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of ``edges(u, v)``; equal roots, one component."""
    edges = cut(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    labels: DataFrame | None = None
    turn = 0
    while not edges.isEmpty():
        turn += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # The order of the nodes is a new one every round: no chain can be laid out so that it falls one by one.
        place = lambda c: F.xxhash64(F.lit(turn), c)  # noqa: E731, B023
        nearest = both.groupBy("u").agg(F.min_by("v", place(F.col("v"))).alias("v"))
        root = F.when((place(F.col("v")) < place(F.col("u"))) | ((place(F.col("v")) == place(F.col("u"))) & (F.col("v") < F.col("u"))), F.col("v")).otherwise(F.col("u"))
        hooked = cut(nearest.select(F.col("u").alias("node"), root.alias("root")))
        if labels is None:
            labels = hooked
        else:
            step = hooked.select(F.col("node").alias("root"), F.col("root").alias("next"))
            older, labels = labels, cut(labels.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
            drop_cut(older)
        a = hooked.select(F.col("node").alias("u"), F.col("root").alias("a"))
        b = hooked.select(F.col("node").alias("v"), F.col("root").alias("b"))
        done, edges = edges, cut(edges.join(a, "u").join(b, "v").where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
        drop_cut(done)
        if turn > 1:
            drop_cut(hooked)
    return labels if labels is not None else edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def grouped(df: DataFrame, senders: DataFrame) -> DataFrame:
    """``(row_id, first_row_id)``: every row with the smallest row of its component."""
    keys = keys_of(df)
    shared = keys.where("t is not null").groupBy("t").agg(F.count("*").alias("n")).where("n > 1").select("t", F.lit(True).alias("links"))
    rows = cut(keys.join(shared, "t", "left").select("row_id", "s", "c", F.when(F.col("links"), F.col("t")).alias("t")).withColumn("anchor", F.coalesce("s", "c", "t")))
    linked = rows.where("anchor is not null")
    aliases = senders.select(F.col("sender_id").alias("x"), F.col("alias_of").alias("y")).where("x is not null and y is not null").select(_key("sender", F.col("x").cast("string")).alias("u"), _key("sender", F.col("y").cast("string")).alias("v"))
    edges = linked.select(F.col("anchor").alias("u"), F.explode(F.array_compact(F.array("c", "t"))).alias("v")).where("u <> v").distinct().unionByName(aliases)
    roots = components(edges)
    first_of_key = linked.groupBy("anchor").agg(F.min("row_id").alias("first"))
    known = cut(first_of_key.join(roots.withColumnRenamed("node", "anchor"), "anchor", "left").select("anchor", "first", F.coalesce("root", "anchor").alias("root")))
    firsts = known.groupBy("root").agg(F.min("first").alias("first_row_id"))
    by_key = known.join(firsts, "root").select("anchor", "first_row_id")
    return rows.select("row_id", "anchor").join(by_key, "anchor", "left").select("row_id", F.coalesce("first_row_id", "row_id").alias("first_row_id"))


def found(df: DataFrame, senders: DataFrame) -> DataFrame:
    """``(first_row_id, row_id)`` of each row of a linked group but its smallest."""
    return grouped(df, senders).where("row_id <> first_row_id").select("first_row_id", "row_id")


def _need(needs: dict[str, list[float]], label: int) -> dict[str, float]:
    """How much of a label each split still needs."""
    return {s: max(0.0, n[label]) for s, n in needs.items()}


def _place(needs: dict[str, list[float]], vector: list[float], label: int) -> str:
    """The split for one component: it needs the label most, then any label most."""
    best = max(needs, key=lambda s: (needs[s][label], sum(needs[s]), s))
    for k, v in enumerate(vector):
        needs[best][k] -= v
    return best


def _place_many(needs: dict[str, list[float]], count: int, vector: list[float], label: int, shares: dict[str, float]) -> dict[str, int]:
    """How many components of one class go to each split: in proportion to what the splits still need of the label, by largest remainders."""
    want = {s: min(x, max(0.0, sum(needs[s]))) for s, x in _need(needs, label).items()}
    if not sum(want.values()):
        want = dict(shares)
    exact = {s: count * w / sum(want.values()) for s, w in want.items()}
    given = {s: int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (given[s] - exact[s], s))[: count - sum(given.values())]:
        given[s] += 1
    for s, n in given.items():
        for k, v in enumerate(vector):
            needs[s][k] -= n * v / count
    return given


def _plan(large: Iterable, classes: Iterable, shares: dict[str, float], totals: list[float]) -> tuple[dict, list[tuple]]:
    """Places of the large components, and of each class of small ones the ranks that go to each split.

    Turn by turn the label of which the fewest rows are outstanding: its components, the largest first,
    each alone or a class of equal ones together; then what is outstanding is counted anew.
    """
    needs = {s: [share * t for t in totals] for s, share in shares.items()}
    waiting = [(root, 1, list(vector), True) for root, vector in large] + [(name, count, list(vector), False) for name, count, vector in classes]
    placed, ranges = {}, []
    while waiting:
        outstanding = [sum(v[k] for _, _, v, _ in waiting) for k in range(len(totals))]
        label = min((k for k, n in enumerate(outstanding) if n > 0), key=lambda k: (outstanding[k], k))
        turn = sorted((x for x in waiting if x[2][label] > 0), key=lambda x: (-sum(x[2]) / x[1], str(x[0])))
        waiting = [x for x in waiting if x[2][label] <= 0]
        for name, count, vector, alone in turn:
            if alone:
                placed[name] = _place(needs, vector, label)
                continue
            at = 0
            for s, n in _place_many(needs, count, vector, label, shares).items():
                if n:
                    ranges.append((name, at, at + n, s))
                at += n
    return placed, ranges


def assigned(df: DataFrame, senders: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """``(row_id, split)`` of every row."""
    spark = df.sparkSession
    shares = {r["split"]: float(r["share"]) for r in targets.where("split is not null and share is not null").orderBy("split").limit(MOST_SPLITS + 1).collect()}
    if len(shares) > MOST_SPLITS:
        raise ValueError("too many splits for a plan on the driver")
    shares = {s: x / sum(shares.values()) for s, x in shares.items()}
    groups = cut(grouped(df, senders))
    labelled = groups.join(df.select("row_id", "status"), "row_id")
    count = lambda label: F.count_if(F.col("status").eqNullSafe(label))
    vectors = cut(labelled.groupBy(F.col("first_row_id").alias("root")).agg(*[count(x).alias(f"l{k}") for k, x in enumerate(LABELS)], F.count("*").alias("n")).withColumn(f"l{len(LABELS)}", F.expr("n - " + " - ".join(f"l{k}" for k in range(len(LABELS))))))
    names = [f"l{k}" for k in range(len(LABELS) + 1)]
    summed = vectors.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("m"), *[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in names]).first()
    totals, limit = [float(summed[x]) for x in names], summed["n"] / LARGE
    large = [(r["root"], [float(r[x]) for x in names]) for r in vectors.where(F.col("n") > limit).collect()]
    # Classes: the vector itself up to 16 rows, beyond that its size as a power of two and its mix in tenths.
    tenth = lambda x: F.round(F.col(x) * 10 / F.col("n")).cast("int")
    small = vectors.where(F.col("n") <= limit).withColumn("class", F.when(F.col("n") <= 16, F.concat_ws("/", *names)).otherwise(F.concat_ws("/", F.lit("p"), F.floor(F.log2("n")), *[tenth(x) for x in names])))
    salts = max(1, summed["m"] // SALT_ROWS)
    small = small.withColumn("order", F.xxhash64(F.lit(seed), F.col("root"))).withColumn("salt", F.pmod("order", F.lit(salts)))
    classes = [(r["class"], r["m"], [float(r[x]) for x in names]) for r in small.groupBy("class").agg(F.count("*").alias("m"), *[F.sum(x).alias(x) for x in names]).collect()]
    placed, ranges = _plan(large, classes, shares, totals)
    # The seeded rank within a class, in two levels: no task sorts a whole class.
    offsets = small.groupBy("class", "salt").agg(F.count("*").alias("m")).withColumn("offset", F.sum("m").over(W.partitionBy("class").orderBy("salt").rowsBetween(W.unboundedPreceding, -1))).select("class", "salt", F.coalesce("offset", F.lit(0)).alias("offset"))
    ranked = small.join(offsets, ["class", "salt"]).withColumn("rank", F.col("offset") + F.row_number().over(W.partitionBy("class", "salt").orderBy("order", "root")) - 1)
    table = spark.createDataFrame(ranges, "class string, low bigint, high bigint, split string")
    by_rank = ranked.join(table, (ranked["class"] == table["class"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).select("root", "split")
    by_name = spark.createDataFrame(list(placed.items()), "root bigint, split string")
    chosen = by_rank.unionByName(by_name)
    return groups.join(chosen, groups["first_row_id"] == chosen["root"]).select("row_id", "split")


def report(df: DataFrame, senders: DataFrame, targets: DataFrame) -> DataFrame:
    """Shares reached of each split: rows and rows of each status."""
    done = assigned(df, senders, targets).join(df.select("row_id", "status"), "row_id").groupBy("split").agg(F.count("*").alias("n_rows"), F.count_if(F.col("status") == "Scam").alias("n_scam"), F.count_if(F.col("status") == "Genuine").alias("n_genuine"))
    total = done.agg(F.sum("n_rows").alias("t"))
    return done.crossJoin(F.broadcast(total)).join(targets.select("split", "share"), "split", "left").select("split", "n_rows", "n_scam", "n_genuine", (F.col("n_rows") / F.col("t")).alias("actual_share"), F.col("share").alias("target_share"))
