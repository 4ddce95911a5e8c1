"""Leakage-safe pregame history: features of an entity frozen at its game's first event."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.operators.ordered import join_null_safe
from fieldglass.plans.gold import pitch_model_features
from fieldglass.session import cut_lineage, written_table

MICROS_PER_DAY = 86_400_000_000
EVENT_ORDER = ["at_bat_number", "pitch_number", "pitch_id"]


@dataclass(frozen=True)
class Entity:
    """An entity's key, its frames, and the names of the produced columns."""

    name: str
    keys: list[str]
    rows: int
    days: list[int] = field(default_factory=list)


# Frame lengths per entity.
ENTITIES = [
    Entity("pitcher", ["pitcher_id"], 200, [30, 14]),
    Entity("batter", ["batter_id"], 50, [30, 14]),
    Entity("pitcher_pitch_type", ["pitcher_id", "pitch_type"], 100, [30]),
    Entity("batter_pitch_type", ["batter_id", "pitch_type"], 30, [30]),
    Entity("matchup", ["pitcher_id", "batter_id"], 30),
]


@dataclass(frozen=True)
class Target:
    key: str
    label: str
    events: str
    rate: str
    sample_suffix: str

    def rows_of(self, entity: "Entity") -> int:
        """Batted balls per matchup are rarer than swings, so that one frame is shorter."""
        return 20 if self.key == "hard_hit" and entity.name == "matchup" else entity.rows

    def count_name(self, entity: Entity, frame: str) -> str:
        return f"{entity.name}_{self.events}_prior_{frame}"

    def rate_name(self, entity: Entity, frame: str) -> str:
        rate = self.rate
        if self.key == "hard_hit" and entity.keys[0] == "pitcher_id" and "batter_id" not in entity.keys:
            rate = f"{rate}_allowed"
        tail = f"_{self.sample_suffix}" if not frame.endswith("d") else ""
        return f"{entity.name}_{rate}_prior_{frame}{tail}"


WHIFF = Target("whiff", "whiff_flag", "swings", "whiff_rate", "swings")
HARD_HIT = Target("hard_hit", "hard_hit_flag", "batted_balls", "hard_hit_rate", "batted_balls")


def eligible(features: DataFrame, target: Target) -> DataFrame:
    if target.key == "whiff":
        return features.filter(F.col("swing_flag") == 1)
    return features.filter((F.col("batted_ball_flag") == 1) & F.col("hard_hit_flag").isNotNull())


_WHO = ["kind", "ka", "kb"]


def by_entity(events: DataFrame, entities: list[Entity], *columns: str) -> DataFrame:
    """One row per event and entity kind it belongs to: (kind, ka, kb) name the entity; missing keys belong to none."""
    text = lambda e, i: F.col(e.keys[i]).cast("string") if i < len(e.keys) else F.lit("")
    who = F.array(*[F.struct(F.lit(i).alias("kind"), text(e, 0).alias("ka"), text(e, 1).alias("kb")) for i, e in enumerate(entities)])
    spread = events.select(*columns, F.explode(who).alias("__w")).select(*columns, "__w.*")
    return spread.filter(F.col("ka").isNotNull() & F.col("kb").isNotNull())


def entity_games(events: DataFrame, entities: list[Entity], label: str, target: Target, instant: str = "game_datetime_utc", game: str = "game_pk") -> DataFrame:
    """One row per entity and game, for all kinds at once: counts and label sums over earlier events only.

    A game has one instant, so an entity's events are contiguous per game, and frames range over
    entity-game totals.  The left edge of the last-n frame lies inside some earlier game: that game is found
    among the totals, and only the events of such games are numbered.  Joins whose sides both grow with the
    events are merge joins: Spark takes a written table for as large as its compressed files, an exploded one for
    no longer than its source and a checkpoint for what was expected of it, so it may broadcast all their rows,
    and a broadcast once planned is kept if it turns out large.
    """
    staged = events.withColumns({"__at": F.unix_micros(F.col(instant).cast("timestamp")), "__y": F.col(label).cast("bigint")})
    spread = by_entity(staged, entities, game, "__at", *EVENT_ORDER, "__y")
    games = spread.groupBy(*_WHO, game, "__at").agg(F.count("*").alias("__n"), F.sum("__y").alias("__s"))
    before = Window.partitionBy(*_WHO).orderBy(F.col("__at").asc_nulls_last(), game).rowsBetween(Window.unboundedPreceding, -1)
    games = games.withColumns({"__before": F.coalesce(F.sum("__n").over(before), F.lit(0)), "__hits": F.coalesce(F.sum("__s").over(before), F.lit(0))})
    moments = Window.partitionBy(*_WHO).orderBy("__at")
    so_far = moments.rangeBetween(Window.unboundedPreceding, -1)
    for days in sorted({d for e in entities for d in e.days}):
        # Differences of sums from the beginning: a sliding frame would be summed anew at every instant.
        gone = moments.rangeBetween(Window.unboundedPreceding, -days * MICROS_PER_DAY - 1)
        n, known, hits = [part.over(so_far) - F.when(F.col("__at").isNull(), F.lit(0)).otherwise(F.coalesce(part.over(gone), F.lit(0)))
                          for part in (F.sum("__n"), F.count("__s"), F.sum("__s"))]
        games = games.withColumns({f"__n{days}": F.coalesce(n, F.lit(0)), f"__s{days}": F.when(known > 0, hits)})
    length = F.coalesce(*[F.when(F.col("kind") == i, F.lit(target.rows_of(e)).cast("bigint")) for i, e in enumerate(entities)])
    games = cut_lineage(games.withColumn("__rows", length))

    # Positions where games begin and positions of edges on one axis: the last beginning before an edge is its game.
    here = F.struct(game, F.col("__before"), F.col("__hits"), F.col("__n"), F.col("__s"))
    begin = F.struct(F.col("__before").alias("pos"), F.lit(0).alias("role"), here.alias("spot"), F.when(F.lit(False), F.col(game)).alias("asks"))
    edge = F.struct((F.col("__before") - F.col("__rows") - 1).alias("pos"), F.lit(1).alias("role"), F.when(F.lit(False), here).alias("spot"), F.col(game).alias("asks"))
    axis = games.select(*_WHO, F.explode(F.array(begin, edge)).alias("__p")).select(*_WHO, "__p.*").filter("pos >= 0")
    along = Window.partitionBy(*_WHO).orderBy("pos", "role").rowsBetween(Window.unboundedPreceding, 0)
    spots = axis.withColumn("spot", F.last("spot", ignorenulls=True).over(along)).filter("role = 1")
    spots = spots.select(*_WHO, F.col("asks").alias(game), F.col(f"spot.{game}").alias("__in"), (F.col("pos") + 1 - F.col("spot.__before")).alias("__j"),
                         F.col("spot.__hits").alias("__base"), F.col("spot.__n").alias("__whole"), F.col("spot.__s").alias("__all"))
    spots = cut_lineage(spots)
    cut_games = spots.filter("__j < __whole").select(*_WHO, F.col("__in").alias(game)).distinct()
    inside = Window.partitionBy(*_WHO, game).orderBy(*EVENT_ORDER)
    numbered = spread.join(cut_games.hint("merge"), [*_WHO, game], "left_semi").withColumns({
        "__j": F.row_number().over(inside).cast("bigint"), "__c": F.sum("__y").over(inside.rowsBetween(Window.unboundedPreceding, 0))})
    numbered = numbered.select(*_WHO, F.col(game).alias("__in"), "__j", "__c")
    found = spots.join(numbered.hint("merge"), [*_WHO, "__in", "__j"], "left")
    found = found.select(*_WHO, game, (F.col("__base") + F.when(F.col("__j") == F.col("__whole"), F.col("__all")).otherwise(F.col("__c"))).alias("__edge"))
    return games.join(found.hint("merge"), [*_WHO, game], "left")


def _measures(entity: Entity, target: Target) -> dict[str, Column]:
    """The produced columns of one kind, from the columns of `entity_games`."""
    count = F.least(F.col("__before"), F.col("__rows"))
    hits = F.col("__hits") - F.coalesce("__edge", F.lit(0))
    frame = str(target.rows_of(entity))
    out = {target.count_name(entity, frame): count, target.rate_name(entity, frame): hits / F.when(count > 0, count)}
    for days in entity.days:
        n, s = F.col(f"__n{days}"), F.col(f"__s{days}")
        out |= {target.count_name(entity, f"{days}d"): n, target.rate_name(entity, f"{days}d"): s / F.when(n > 0, n)}
    return out


def entity_history(events: DataFrame, entity: Entity, label: str, target: Target, instant: str = "game_datetime_utc", game: str = "game_pk") -> DataFrame:
    """One row per game of one kind of entity, under its own key columns."""
    games = entity_games(events, [entity], label, target, instant, game)
    keys = [F.col(name).cast(events.schema[k].dataType).alias(k) for k, name in zip(entity.keys, ("ka", "kb"))]
    return games.select(*keys, game, *[value.alias(name) for name, value in _measures(entity, target).items()])


def pregame_training(features: DataFrame, target: Target, entities: list[Entity] | None = None, materialise: bool = True) -> DataFrame:
    """Eligible pitches with every entity's frozen history and the renamed label.

    All kinds of entities go through one exploded frame: slim event rows (game, pitch, entity) meet the
    entity-games once, and the measures of a pitch come back to one row by an aggregation.  Pitches that
    lack a key of some entity are left out.
    """
    entities = entities or ENTITIES
    rows = eligible(features, target)
    if materialise:
        rows = written_table(rows)
    games = entity_games(rows, entities, target.label, target)
    met = by_entity(rows, entities, "game_pk", "pitch_id").join(games.hint("merge"), [*_WHO, "game_pk"])
    measures = [F.max(F.when(F.col("kind") == i, value)).alias(name) for i, e in enumerate(entities) for name, value in _measures(e, target).items()]
    wide = met.groupBy("game_pk", "pitch_id").agg(F.bit_or(F.expr("shiftleft(1, kind)")).alias("__kinds"), *measures)
    wide = wide.filter(F.col("__kinds") == (1 << len(entities)) - 1).drop("__kinds")
    return rows.join(wide.hint("merge"), ["game_pk", "pitch_id"]).withColumn(f"target_{target.key}", F.col(target.label)).drop(
        "swing_flag", "whiff_flag", "batted_ball_flag", "hard_hit_flag"
    )


def training_marts(fact: DataFrame, context: DataFrame) -> dict[str, DataFrame]:
    features = pitch_model_features(fact, context)
    return {t.key: pregame_training(features, t) for t in (WHIFF, HARD_HIT)}


def first_event_of_game(events: DataFrame, keys: list[str], game: str, order: list[str], name: str = "is_first") -> DataFrame:
    """Mark the first event of each entity-game; `order` must tell its events apart.

    The least order tuple is an aggregate with partial results, so no entity-game is sorted in one task.
    """
    first = events.groupBy(*keys, game).agg(F.min(F.struct(*order)).alias("__first"))
    marked = join_null_safe(events, first, [*keys, game])
    return marked.withColumn(name, F.struct(*order).eqNullSafe(F.col("__first"))).drop("__first")
