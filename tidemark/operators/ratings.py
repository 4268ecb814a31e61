"""Ratings replayed by blocks of time as a Spark loop: no task holds a pool, and the work of a step grows with its block.

A contest is rated from the results that were known when its block began, so contests of one block never see each other. A step joins the
block's contests with the ratings, works out all moves, and writes them; the moves that a later block may use are summed by entity there.
Ratings and moves are whole millionths of a point, so sums do not depend on their order.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.storage import shared_path, written

UNIT = 1_000_000


@dataclass(frozen=True)
class Rules:
    """start: of an entity whose group has no rated members. margin: larger results move more. reversion: share of the distance to the group's mean
    that a new season takes away. entry: how far below its group's mean an entity starts. bridge_k: step of the group offsets in contests
    across groups; bridge_share: share of the ordinary step that entities make there."""

    start: float = 1500.0
    k: float = 20.0
    edge: float = 60.0
    margin: bool = True
    reversion: float = 0.25
    entry: float = 50.0
    bridge_k: float = 6.0
    bridge_share: float = 0.5


def units(c: Column) -> Column:
    return F.round(c * UNIT).cast("long")


def block_of(at: str, length: int) -> Column:
    """Number of the block of `length` seconds that holds an instant."""
    return F.floor(F.unix_seconds(at) / length).cast("long")


def known_block(known_at: str, block: str, length: int) -> Column:
    """The first block that begins once a result is known, later than the contest's own."""
    return F.greatest(F.ceil(F.unix_micros(known_at) / (length * UNIT)).cast("long"), F.col(block) + 1)


#: Contests in one file of a block, about, so that a block of any size is read and rated by many tasks.
LOT_ROWS = 250_000


def replay(contests: DataFrame, rules: dict[str, Rules], also: tuple[str, ...] = ()) -> DataFrame:
    """Ratings before each contest under every variant of the rules, in one replay.

    contests: contest, block, known (see `block_of`, `known_block`), l, r (entities), lg, rg (their groups), season (text, in order), bridge
    (a contest across groups), y (0 left, 1 equal, 2 right; null while unsettled: rated, moves nothing), margin. Rows lacking anything but y and
    margin are left out. Gives variant, contest, block, left_rating, right_rating, diff, expected, settled_before (least number of earlier
    results of both), move, and those of known, l, r, lg, rg, bridge and y that `also` names.

    What an entity has in common under all variants is kept once, with a rating for each beside it, and a contest meets its entities once; only then it becomes a row a variant.
    """
    spark, names = contests.sparkSession, list(rules)
    text = ["l", "r", "lg", "rg", "season"]
    needed = ["contest", "block", "known", *text, "bridge"]
    # by block on disk, so a step reads its own contests only
    root, c = shared_path(spark, "rating-contests"), contests.select(*[F.col(x).cast("string") if x in text else F.col(x) for x in needed], F.col("y").cast("int"), F.abs("margin").alias("margin")).dropna(subset=needed)
    blocks = [(r["block"], r["last"], r["n"]) for r in c.groupBy("block").agg(F.max("known").alias("last"), F.count("*").alias("n")).orderBy("block").collect()]
    lots = max([n for *_, n in blocks], default=0) // LOT_ROWS + 1
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in c.schema.fields)
    c.repartition("block", F.pmod(F.xxhash64("contest"), F.lit(lots))).write.partitionBy("block").parquet(root)
    c = spark.read.schema(kinds).parquet(root)
    each = lambda kind, *columns: "".join(f", {x}{i} {kind}" for i in range(len(names)) for x in columns)
    entities = _none(spark, f"entity string, grp string, season string, n long, seen boolean{each('long', 'r')}")
    groups = _none(spark, f"grp string, members long{each('long', 'o', 'm')}")
    result = "variant string, contest " + c.schema["contest"].dataType.simpleString() + ", block long, known long, l string, r string, lg string, rg string, bridge boolean, y int, left_rating double, right_rating double, diff double, expected double, settled_before long, move long, shift long"
    out, before, begun = shared_path(spark, "ratings"), None, False
    told: list[tuple[str, int]] = []
    for block, last, _ in blocks:
        now = c.where(F.col("block") == block)
        open_paths = [p for p, known in told if before is None or known > before]
        if open_paths:
            due = spark.read.schema(result).parquet(*open_paths).where((F.col("known") > before) & (F.col("known") <= block) & F.col("y").isNotNull())
            entities = written(_moved(entities, due, names), "rating-moved")
        else:
            due = None
        if told:
            groups = written(_groups(groups, entities, due, names), "rating-groups")
            begun = bool(groups.where("members > 0").head(1))
        entities = written(_with_entrants(entities, now, groups, begun, list(rules.values())), "rating-state")
        path = f"{out}/{len(told):06d}"
        _rated(now, entities, groups, rules).write.parquet(path)
        told.append((path, last))
        before = block
    done = spark.read.schema(result).parquet(*[p for p, _ in told]) if told else _none(spark, result)
    return done.select("variant", "contest", "block", "left_rating", "right_rating", "diff", "expected", "settled_before", (F.col("move") / UNIT).alias("move"), *also)


def _none(spark: SparkSession, columns: str) -> DataFrame:
    """No rows of these columns, which need no task."""
    return spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in (x.split() for x in columns.split(", "))])


def _sums(names: list[str]) -> list[Column]:
    """The sum of `add` under each variant."""
    return [F.sum(F.when(F.col("variant") == v, F.col("add"))).alias(f"add{i}") for i, v in enumerate(names)]


def _moved(entities: DataFrame, due: DataFrame, names: list[str]) -> DataFrame:
    """The entities after the results that have become known."""
    side = lambda own, sign: F.struct(F.col(own).alias("entity"), (sign * F.col("move")).alias("add"))
    moves = due.select("variant", (~F.col("bridge")).alias("home"), F.explode(F.array(side("l", 1), side("r", -1))).alias("s")).select("variant", "home", "s.*")
    moves = moves.groupBy("entity").agg(F.count_if(F.col("variant") == names[0]).alias("more"), F.max("home").alias("home"), *_sums(names))
    return entities.join(moves, "entity", "left").select(
        "entity", "grp", "season", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), (F.col("seen") | F.coalesce("home", F.lit(False))).alias("seen"),
        *[(F.col(f"r{i}") + F.coalesce(f"add{i}", F.lit(0))).alias(f"r{i}") for i in range(len(names))],
    )


def _groups(groups: DataFrame, entities: DataFrame, due: DataFrame | None, names: list[str]) -> DataFrame:
    """Each group's offsets, how many rated members it has, and their means (null: none)."""
    means = [F.round(F.sum(f"r{i}") / F.count("*")).cast("long").alias(f"m{i}") for i in range(len(names))]
    both = groups.drop("members", *[f"m{i}" for i in range(len(names))]).join(entities.where("seen").groupBy("grp").agg(F.count("*").alias("members"), *means), "grp", "full")
    if due is None:
        both = both.withColumns({f"add{i}": F.lit(0) for i in range(len(names))})
    else:
        side = lambda own, sign: F.struct(F.col(own).alias("grp"), (sign * F.col("shift")).alias("add"))
        shifts = due.where("shift is not null").select("variant", F.explode(F.array(side("lg", 1), side("rg", -1))).alias("s")).select("variant", "s.*")
        both = both.join(shifts.groupBy("grp").agg(*_sums(names)), "grp", "full")
    return both.select("grp", F.coalesce("members", F.lit(0)).cast("long").alias("members"), *[x for i in range(len(names)) for x in ((F.coalesce(f"o{i}", F.lit(0)) + F.coalesce(f"add{i}", F.lit(0))).cast("long").alias(f"o{i}"), F.col(f"m{i}"))])


def _with_entrants(entities: DataFrame, now: DataFrame, groups: DataFrame, begun: bool, rules: list[Rules]) -> DataFrame:
    """The entities with those that the block brings, and with those whose season is new drawn to the mean of their group."""
    side = lambda own, grp: F.struct(F.col(own).alias("entity"), F.col(grp).alias("its"))
    sides = now.select("season", "bridge", F.explode(F.array(side("l", "lg"), side("r", "rg"))).alias("s")).select("season", "bridge", "s.*")
    entrants = sides.groupBy("entity").agg(F.min("its").alias("its"), F.max("season").alias("to"), F.min("bridge").alias("abroad"))
    both = entities.join(entrants, "entity", "full").withColumn("its", F.coalesce("grp", "its")).join(groups.drop("members").withColumnRenamed("grp", "its"), "its", "left")
    ratings = []
    for i, v in enumerate(rules):
        mean, r = F.coalesce(f"m{i}", units(F.lit(float(v.start)))), F.col(f"r{i}")
        entry = mean - F.when(F.lit(begun) & ~F.col("abroad"), units(F.lit(float(v.entry)))).otherwise(0)
        drawn = mean + F.round((1 - F.lit(float(v.reversion))) * (r - mean)).cast("long")
        ratings.append(F.when(r.isNull(), entry).when(F.col("to") > F.col("season"), drawn).otherwise(r).alias(f"r{i}"))
    return both.select("entity", F.col("its").alias("grp"), F.greatest("season", "to").alias("season"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("seen", F.lit(False)).alias("seen"), *ratings)


def _rated(now: DataFrame, entities: DataFrame, groups: DataFrame, rules: dict[str, Rules]) -> DataFrame:
    own = lambda p: entities.select(F.col("entity").alias(p), F.col("n").alias(f"{p}_n"), *[F.col(f"r{i}").alias(f"{p}{i}") for i in range(len(rules))])
    off = lambda g: groups.select(F.col("grp").alias(g), *[F.col(f"o{i}").alias(f"{g}{i}") for i in range(len(rules))])
    c = now.join(own("l"), "l").join(own("r"), "r").join(off("lg"), "lg", "left").join(off("rg"), "rg", "left")
    given = lambda v, r: [F.lit(v).alias("variant"), *[F.lit(x if isinstance(x, bool) else float(x)).alias(k) for k, x in asdict(r).items() if k in ("k", "edge", "margin", "bridge_k", "bridge_share")]]
    each = [F.struct(*given(v, r), *[F.col(f"{p}{i}").alias(f"{p}_units") for p in ("l", "r", "lg", "rg")]) for i, (v, r) in enumerate(rules.items())]
    c = c.select("contest", "block", "known", "l", "r", "lg", "rg", "bridge", "y", F.col("margin").alias("by"), F.least("l_n", "r_n").alias("settled_before"), F.explode(F.array(*each)).alias("v")).select("*", "v.*").drop("v")
    offset = F.when(F.col("bridge"), F.coalesce("lg_units", F.lit(0)) - F.coalesce("rg_units", F.lit(0))).otherwise(0)
    diff = (F.col("l_units") - F.col("r_units") + units(F.col("edge")) + offset) / UNIT
    c = c.withColumn("diff", diff).withColumn("expected", 1 / (1 + F.pow(F.lit(10.0), -F.col("diff") / 400)))
    size = F.when(F.col("margin"), 1 + F.log1p(F.coalesce("by", F.lit(0)).cast("double"))).otherwise(1.0) * (1 - F.col("y") / 2 - F.col("expected"))
    move = units(F.when(F.col("bridge"), F.col("bridge_share")).otherwise(1.0) * F.col("k") * size)
    shift = F.when(F.col("bridge") & (F.col("lg") != F.col("rg")), units(F.col("bridge_k") * size))
    return c.select(
        "variant", "contest", "block", "known", "l", "r", "lg", "rg", "bridge", "y", (F.col("l_units") / UNIT).alias("left_rating"), (F.col("r_units") / UNIT).alias("right_rating"), "diff", "expected",
        "settled_before", move.alias("move"), shift.alias("shift"),
    )


def loss(expected: Column, y: Column) -> Column:
    """Log loss of the left side's expected score, a tie counted as half of each."""
    score, e = 1 - y / 2, F.least(F.greatest(expected, F.lit(1e-12)), F.lit(1 - 1e-12))
    return -(score * F.log(e) + (1 - score) * F.log(1 - e))


def tuned(scored: DataFrame, fold: str) -> DataFrame:
    """The variant of least mean loss over all folds before each fold, and what it scores there: fold, variant, inner_n, inner_loss, n, loss.

    scored: variant, loss and the fold's number; rows without loss do not count. Ties go by the variant's name.
    """
    sums = scored.groupBy("variant", fold).agg(F.count("loss").alias("n"), F.sum("loss").alias("s"))
    earlier = Window.partitionBy("variant").orderBy(fold).rowsBetween(Window.unboundedPreceding, -1)  # one row a fold
    inner = sums.select("variant", fold, F.sum("n").over(earlier).alias("inner_n"), (F.sum("s").over(earlier) / F.sum("n").over(earlier)).alias("inner_loss"))
    best = inner.where("inner_n > 0").groupBy(fold).agg(F.min(F.struct(F.round("inner_loss", 12).alias("x"), "variant", "inner_n", "inner_loss")).alias("b"))
    return best.select(fold, "b.variant", "b.inner_n", "b.inner_loss").join(sums.select("variant", fold, "n", (F.col("s") / F.col("n")).alias("loss")), ["variant", fold], "left")
