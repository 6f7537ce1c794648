"""Whether predicted result sets carry the same answer as the gold ones."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.constants import RESULT_TOLERANCE
from lamina.operators.ordered import rank_within
from lamina.session import durable

# Rows of one group that one task pairs by trying, a few megabytes; a larger group with several floats is cut first, and
# what is still larger is ranked.
PAIR_ROWS = 20_000

_FLOATS = (T.FloatType, T.DoubleType, T.DecimalType)


def has_explicit_order(sql: Column) -> Column:
    """True when a gold query pins its row order."""
    return F.coalesce(sql.rlike(r"(?i)\border\s+by\b"), F.lit(False))


def cells_match(left: Column, right: Column, tolerance: float = RESULT_TOLERANCE) -> Column:
    """Two doubles agree within a relative tolerance; NaN equals NaN and NULL equals NULL."""
    scale = F.greatest(F.abs(left), F.abs(right), F.lit(1e-9))
    near = F.abs(left - right) / scale <= tolerance
    same = left.eqNullSafe(right) | (F.isnan(left) & F.isnan(right)) | near
    return F.coalesce(same, F.lit(False))


def _canonical(pred: DataFrame, gold: DataFrame, values: Sequence[str], by: Sequence[str],
               extra: Sequence[str]) -> tuple[DataFrame, DataFrame, list[str], list[str]]:
    """Cast both sides alike: exact keys ``e0..`` for counts and texts, doubles ``f0..`` else.

    Two whole-number columns are counts and stay exact; a float or decimal on either side makes
    both doubles; everything else is compared as trimmed text. Columns pair by position, so
    their names do not matter and further predicted columns are ignored.
    """
    exact, approx, kinds = [], [], []
    gold_columns = [c for c in gold.columns if c in values]
    pred_columns = [c for c in pred.columns if c not in (*by, *extra)][: len(gold_columns)]
    if len(pred_columns) < len(gold_columns):
        raise ValueError("the predicted table has fewer columns than the gold one")
    for i, (p, g) in enumerate(zip(pred_columns, gold_columns)):
        types = [pred.schema[p].dataType, gold.schema[g].dataType]
        numeric = [isinstance(t, (T.NumericType, T.BooleanType)) for t in types]
        if all(numeric) and any(isinstance(t, _FLOATS) for t in types):
            kinds.append("double")
            approx.append(f"v{i}")
        else:
            kinds.append("bigint" if all(numeric) else "mixed" if any(numeric) else "string")
            exact.append(f"v{i}")

    def cell(df: DataFrame, name: str, kind: str) -> Column:
        value = F.col(name)
        if kind in ("string", "mixed"):
            text = F.trim(value.cast("string"))
            # A number never equals a text, however it is written.
            numeric = isinstance(df.schema[name].dataType, (T.NumericType, T.BooleanType))
            return F.concat(F.lit("number "), text) if kind == "mixed" and numeric else text
        return value.cast(kind)

    def cast(df: DataFrame, names: Sequence[str]) -> DataFrame:
        cells = [cell(df, c, kind).alias(f"v{i}") for i, (c, kind) in enumerate(zip(names, kinds))]
        return df.select(*by, *extra, *cells)

    return cast(pred, pred_columns), cast(gold, gold_columns), exact, approx


def result_diff(
    pred: DataFrame, gold: DataFrame, by: Sequence[str] = (), position: str | None = None,
    tolerance: float = RESULT_TOLERANCE, pair_rows: int = PAIR_ROWS,
) -> DataFrame:
    """Compare two result tables, per group of ``by``: (n_pred, n_gold, unmatched, matches).

    With ``position`` the rows are compared in that order. Without it they are multisets: where
    both sides hold the same rows, floats rounded to 6 digits, they match; elsewhere the rows with
    the same exact cells are paired within the tolerance. One float column is paired by rank,
    which succeeds whenever any pairing does. Several are paired by augmenting paths in groups of
    up to ``pair_rows`` rows a side, each in one task that holds its rows. A larger group is cut where a float column has a gap wider than
    the tolerance. Only a piece that is still larger and whose columns, each by itself, all pair can
    stay open: it is ranked, and ``matches`` is NULL unless something else decides. No group is compared pair by pair or
    inside one task but for those bounded ones.
    """
    keys = list(by)
    extra = [position] if position else []
    values = [c for c in gold.columns if c not in (*keys, *extra)]
    p, g, exact, approx = _canonical(pred, gold, values, keys, extra)

    def rows(df: DataFrame, side: int) -> DataFrame:
        # Exact cells become one text; a null cell is written as such and so equals another.
        tag = F.to_json(F.struct(F.lit(0).alias("_"), *exact), {"ignoreNullFields": "false"})
        floats = F.array(*[F.col(a) for a in approx]).cast("array<double>")
        place = F.col(position).cast("bigint") if position else F.lit(None).cast("bigint")
        return df.select(*keys, F.lit(side).alias("_side"), place.alias("_place"), tag.alias("_tag"), floats.alias("_floats"))

    return _verdicts(rows(p, 1).unionByName(rows(g, -1)), keys, tolerance, pair_rows)


def result_diff_questions(
    cells: DataFrame, questions: DataFrame, tolerance: float = RESULT_TOLERANCE, pair_rows: int = PAIR_ROWS
) -> DataFrame:
    """``result_diff`` for many questions of different shapes in one job.

    ``cells`` hold (id, side, row, col, kind, value): side ``pred`` or ``gold``, row and column from
    0, kind ``int``, ``float`` or ``text``, value as text, NULL for a null cell. ``questions`` hold
    (id, gold_sql): rows are compared in order exactly where the gold query orders them. Columns
    pair by position. Further predicted columns are ignored; a question whose prediction has
    fewer columns than its gold does not match. A question without cells matches: both are empty.
    """
    gold_width = cells.filter("side = 'gold'").groupBy("id").agg((F.max("col") + 1).alias("_wide"))
    pred_width = cells.filter("side = 'pred'").groupBy("id").agg((F.max("col") + 1).alias("_given"))
    used = cells.join(gold_width, "id").filter("col < _wide")
    # A column is approximate if all its cells are numbers and some a float; numbers in a column
    # with texts never equal a text.
    shape = used.groupBy("id", "col").agg(
        F.bool_or(F.col("kind") == "text").alias("_texts"), F.bool_or(F.col("kind") == "float").alias("_some_float"),
        F.bool_or(F.col("kind") != "text").alias("_numbers"),
    )
    kinds = shape.select("id", "col", "_texts", (F.col("_some_float") & ~F.col("_texts")).alias("_float"), (F.col("_texts") & F.col("_numbers")).alias("_mixed"))
    typed = used.join(kinds, ["id", "col"])
    text = F.trim("value")
    number = F.concat(F.when(F.col("_mixed"), "number ").otherwise(""), text)
    exact = F.when(~F.col("_float"), F.struct("col", F.when(F.col("kind") == "text", text).otherwise(number).alias("v")))
    approx = F.when(F.col("_float"), F.struct("col", F.col("value").cast("double").alias("v")))
    per_row = typed.groupBy("id", "side", "row").agg(
        F.to_json(F.sort_array(F.collect_list(exact)), {"ignoreNullFields": "false"}).alias("_tag"),
        F.transform(F.sort_array(F.collect_list(approx)), lambda a: a["v"]).alias("_floats"),
    )
    ordered = questions.select("id", has_explicit_order(F.col("gold_sql")).alias("_ordered"))
    rows = per_row.join(ordered, "id").select(
        "id", F.when(F.col("side") == "pred", 1).otherwise(-1).alias("_side"),
        F.when(F.col("_ordered"), F.col("row").cast("bigint")).alias("_place"), "_tag", "_floats",
    )
    # A prediction for an empty gold result is all surplus.
    bare = cells.filter("side = 'pred'").join(gold_width, "id", "left_anti").select(
        "id", F.lit(1).alias("_side"), F.lit(None).cast("bigint").alias("_place"),
        F.concat(F.lit("row "), F.col("row").cast("string")).alias("_tag"), F.array().cast("array<double>").alias("_floats"),
    ).distinct()
    found = _verdicts(rows.unionByName(bare), ["id"], tolerance, pair_rows)
    narrow = gold_width.join(pred_width, "id").filter("_given < _wide").select("id", F.lit(True).alias("_narrow"))
    none = F.lit(0).cast("bigint")
    return questions.select("id").join(found, "id", "left").join(narrow, "id", "left").select(
        "id", F.coalesce("n_pred", none).alias("n_pred"), F.coalesce("n_gold", none).alias("n_gold"),
        F.coalesce("unmatched", none).alias("unmatched"),
        F.when(F.col("_narrow"), False).when(F.col("n_pred").isNull(), True).otherwise(F.col("matches")).alias("matches"),
    )


def _verdicts(rows: DataFrame, keys: list[str], tolerance: float, pair_rows: int) -> DataFrame:
    """Verdicts per group of ``keys`` over rows (_side 1 or -1, _place, _tag, _floats).

    A row meets rows with its tag at its place. Missed rows are counted, never listed.
    """
    placed = F.col("_place").isNotNull()
    # In order: one row a side and place.
    sides = rows.filter(placed).groupBy(*keys, "_place").agg(
        *[F.max(F.when(F.col("_side") == side, F.struct("_tag", "_floats"))).alias(name) for side, name in ((1, "_p"), (-1, "_g"))]
    )
    in_order = sides.select(*keys, F.when(~_rows_match(F.col("_p"), F.col("_g"), tolerance), 1).otherwise(0).cast("bigint").alias("_missed"), F.lit(True).alias("_sure"))
    # As multisets: tags whose rows differ somewhere. All that is asked of a tag is counted in one pass and stored.
    group = [*keys, "_tag"]
    loose = rows.filter(~placed)
    rounded = F.transform("_floats", lambda f: F.round(f, 6))
    by_side = [F.count_if(F.col("_side") == side).alias(name) for side, name in ((1, "_p"), (-1, "_g"))]
    kinds = loose.groupBy(*group, rounded.alias("_r")).agg(*by_side)
    off = F.abs(F.col("_p") - F.col("_g"))
    widths = kinds.groupBy(*group, F.size("_r").alias("_width")).agg(
        F.sum("_p").alias("_p"), F.sum("_g").alias("_g"), F.sum(off).alias("_off"))
    # Rows of a group mostly have one width; they meet the rows of a tag once for each width that differs.
    differs = (F.col("_off") > 0) & (F.col("_width") > 0)
    whole = Window.partitionBy(*group)
    most = F.greatest(F.sum("_p").over(whole), F.sum("_g").over(whole)) * F.count_if(differs).over(whole)
    groups = durable(widths.withColumn("_most", most))
    none = F.lit(0).cast("bigint")
    counts = groups.select(*keys, "_p", "_g").unionByName(rows.filter(placed).groupBy(*keys).agg(*by_side)).groupBy(*keys).agg(
        F.coalesce(F.sum("_p"), none).alias("n_pred"), F.coalesce(F.sum("_g"), none).alias("n_gold"))
    without = groups.filter("_width = 0 AND _off > 0").select(*keys, F.col("_off").alias("_missed"), F.lit(True).alias("_sure"))
    found = in_order.unionByName(without)
    differing = groups.filter(differs).select(*group, "_width", "_most")
    # With one row a side, or one float, ranks pair as well as anything.
    several = (F.col("_width") > 1) & (F.col("_most") > 1)
    large = several & (F.col("_most") > pair_rows)
    on = [F.col(f"x.{c}").eqNullSafe(F.col(f"d.{c}")) for c in group]
    sized = loose.alias("x").join(differing.alias("d"), on).select("x.*", "d._width", "d._most")
    some_large, some_tried, some_hot = differing.agg(
        F.bool_or(large), F.bool_or(several & ~large), F.bool_or(F.col("_most") > pair_rows)).first()
    if some_large:
        pieces = _with_sizes(_cut_at_gaps(sized.filter(large), group, tolerance).drop("_most"), group)
        sized = sized.filter(~large).unionByName(pieces)
        found = found.unionByName(_missed_by_column(sized.filter(large), keys, tolerance, pair_rows))
    if some_large or some_tried:
        found = found.unionByName(_pair_by_trying(sized.filter(several & ~large), keys, tolerance))
    ranked = _pair_by_rank(sized.filter(~several | large), group, tolerance, pair_rows if some_hot else None)
    # A miss that is sure but counted elsewhere is NULL.
    missed = found.unionByName(ranked.select(*keys, "_missed", "_sure")).groupBy(*keys).agg(
        F.sum(F.coalesce("_missed", F.lit(0))).alias("_unmatched"), F.sum(F.when(F.col("_sure"), F.coalesce("_missed", F.lit(1))).otherwise(0)).alias("_certain")
    )
    met = [F.col(f"c.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys]
    if not keys:
        missed = missed.agg(F.sum("_unmatched").alias("_unmatched"), F.sum("_certain").alias("_certain"))
        joined = counts.alias("c").join(F.broadcast(missed).alias("m"))
    else:
        joined = counts.alias("c").join(missed.alias("m"), met, "left")
    unmatched, certain = F.coalesce("_unmatched", none), F.coalesce("_certain", none)
    same_size = F.col("n_pred") == F.col("n_gold")
    verdict = F.when(~same_size | (certain > 0), False).when(unmatched > 0, F.lit(None).cast("boolean")).otherwise(True)
    return joined.select(
        *[F.col(f"c.{k}").alias(k) for k in keys], "n_pred", "n_gold", unmatched.alias("unmatched"), verdict.alias("matches")
    )


def _with_sizes(rows: DataFrame, group: list[str]) -> DataFrame:
    """``rows`` with ``_most``, the number of rows of their group on the side that has more."""
    sizes = rows.groupBy(*group).agg(F.greatest(
        F.count_if(F.col("_side") == 1), F.count_if(F.col("_side") == -1)).alias("_most"))
    on = [F.col(f"x.{c}").eqNullSafe(F.col(f"d.{c}")) for c in group]
    return rows.alias("x").join(sizes.alias("d"), on).select("x.*", "d._most")


def _cell(value: Column, tolerance: float) -> Column:
    """Number of a cell of doubles: two that agree within the tolerance lie in one cell or in neighbours."""
    least = 1e-9  # smaller magnitudes are compared as this one and lie in cell 0
    # A little wider than needed, so that rounding does no harm.
    width = -float(np.log1p(-tolerance)) * 1.01 + 1e-12
    step = (F.floor(F.log(F.abs(value) / least) / width) + 1).cast("bigint")
    far = 1 << 60  # apart from all others and from each other
    return (
        F.when(value.isNull(), -far - 9).when(F.isnan(value), far + 9).when(F.abs(value) == float("inf"), F.signum(value).cast("bigint") * far)
        .when(F.abs(value) < least, 0).otherwise(F.signum(value).cast("bigint") * step).cast("bigint")
    )


def _cut_at_gaps(rows: DataFrame, group: list[str], tolerance: float) -> DataFrame:
    """``rows`` with the piece of their group written into ``_tag``: rows of two pieces never match.

    A piece is a run of neighbouring cells in each float column. Among the different cells of a column in
    order, cell less rank is the same exactly along a run.
    """
    if tolerance >= 1:
        return rows
    celled = rows.withColumn("_cells", F.transform("_floats", lambda f: _cell(f, tolerance)))
    kinds = celled.select(*group, "_cells").distinct()
    each = kinds.select("*", F.posexplode("_cells").alias("_col", "_cell"))
    ranked = rank_within(each.select(*group, "_col", "_cell").distinct(), [*group, "_col"], ["_cell"], "_rank")
    runs = ranked.select(*group, "_col", "_cell", (F.col("_cell") - F.col("_rank")).alias("_run"))

    def met(names: list[str]) -> list[Column]:
        return [F.col(f"x.{c}").eqNullSafe(F.col(f"d.{c}")) for c in names]

    placed = each.alias("x").join(runs.alias("d"), met([*group, "_col", "_cell"])).select("x.*", "d._run")
    pieces = placed.groupBy(*group, "_cells").agg(F.sort_array(F.collect_list(F.struct("_col", "_run"))).alias("_runs"))
    tag = F.to_json(F.struct(F.col("x._tag").alias("tag"), F.col("d._runs").alias("piece")), {"ignoreNullFields": "false"})
    cut = celled.alias("x").join(pieces.alias("d"), met([*group, "_cells"])).select("x.*", tag.alias("_piece"))
    return cut.drop("_cells", "_tag").withColumnRenamed("_piece", "_tag").select(*rows.columns)


def _missed_by_column(rows: DataFrame, keys: list[str], tolerance: float, window_rows: int) -> DataFrame:
    """Rows of a NULL count for each miss of a float column paired by itself: then no pairing of all fits."""
    each = rows.select(*keys, "_tag", "_side", "_width", "_most", F.posexplode("_floats").alias("_col", "_float"))
    alone = each.withColumn("_floats", F.array("_float")).withColumn("_width", F.lit(1))
    ranked = _pair_by_rank(alone, [*keys, "_tag", "_col"], tolerance, window_rows).filter("_missed > 0")
    return ranked.select(*keys, F.lit(None).cast("bigint").alias("_missed"), F.lit(True).alias("_sure"))


def _floats_match(left: Column, right: Column, tolerance: float) -> Column:
    same = F.zip_with(left, right, lambda a, b: cells_match(a, b, tolerance))
    return (F.size(left) == F.size(right)) & F.forall(same, lambda x: x)


def _rows_match(left: Column, right: Column, tolerance: float) -> Column:
    alike = left["_tag"].eqNullSafe(right["_tag"]) & _floats_match(left["_floats"], right["_floats"], tolerance)
    return F.coalesce(left.isNotNull() & right.isNotNull() & alike, F.lit(False))


def _pair_by_rank(rows: DataFrame, group: list[str], tolerance: float, window_rows: int | None) -> DataFrame:
    """Both sides numbered by value; rows of the same number in a group meet.

    A group of up to ``window_rows`` rows a side is sorted by one task; the others are ranked by many. Without it all groups are that small.
    """
    # NULL sorts first and NaN last, alike on both sides.
    simple = (F.col("_width") <= 1) | (F.col("_most") <= 1)
    flat = rows.select(*group, "_side", simple.alias("_simple"), "_floats", F.get("_floats", F.lit(0)).alias("_first"), "_most")
    hot = F.lit(False) if window_rows is None else F.col("_most") > window_rows
    place = F.row_number().over(Window.partitionBy(*group, "_side").orderBy("_first", "_floats"))
    # Rows of a group stay together for the pairing that follows.
    numbered = flat.filter(~hot).drop("_most").repartition(*group).withColumn("_slot", (place - 1).cast("bigint"))
    if window_rows is not None:
        numbered = numbered.unionByName(rank_within(flat.filter(hot).drop("_most"), [*group, "_side"], ["_first", "_floats"], "_slot", ties=True))
    met = numbered.groupBy(*group, "_slot").agg(
        F.bool_and("_simple").alias("_simple"),
        *[F.max(F.when(F.col("_side") == side, F.struct("_floats"))).alias(name) for side, name in ((1, "_p"), (-1, "_g"))],
    )
    ok = F.coalesce(
        F.col("_p").isNotNull() & F.col("_g").isNotNull() & _floats_match(F.col("_p._floats"), F.col("_g._floats"), tolerance), F.lit(False))
    missed = F.when(ok, 0).otherwise(1).cast("bigint")
    return met.select(*group, missed.alias("_missed"), F.col("_simple").alias("_sure"))


def _pair_by_trying(rows: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Per bounded group, the rows that no pairing within the tolerance can match."""
    names = [f"_k{i}" for i in range(len(keys))]
    kinds = [rows.schema[k].dataType.simpleString() for k in keys]

    def pair(part: pd.DataFrame) -> pd.DataFrame:
        sides = [part.loc[part["_side"] == side, "_floats"] for side in (1, -1)]
        missed = max(map(len, sides)) - largest_pairing(*sides, tolerance)
        return pd.DataFrame({**{n: [part[n].iloc[0]] for n in names}, "_missed": [missed], "_sure": [True]})

    schema = ", ".join([*(f"{n} {k}" for n, k in zip(names, kinds, strict=True)), "_missed long", "_sure boolean"])
    tag = F.to_json(F.struct(F.lit(0).alias("_"), *keys, "_tag"), {"ignoreNullFields": "false"})
    named = rows.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], tag.alias("_group"), "_side", "_floats")
    found = named.groupBy("_group").applyInPandas(pair, schema)
    return found.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], "_missed", "_sure")


def _as_matrix(rows: Sequence[Sequence[float | None]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of doubles, and where they are null."""
    nulls = np.array([[x is None for x in row] for row in rows], bool).reshape(len(rows), -1)
    values = np.array([[np.nan if x is None else x for x in row] for row in rows], float).reshape(nulls.shape)
    return values, nulls


def largest_pairing(left: Sequence, right: Sequence, tolerance: float) -> int:
    """Size of the largest pairing of rows of doubles that agree in every column.

    Rows are first paired in their order, which settles most, then along augmenting paths. Whether two rows agree is worked out when
    it is asked for, one row against all not yet reached, so memory grows with the rows and not with their pairs.
    """
    if not len(left) or not len(right):
        return 0
    (p, p_null), (g, g_null) = _as_matrix(left), _as_matrix(right)

    def fits(row: int, columns: np.ndarray) -> np.ndarray:
        """Which of ``columns`` agree with ``row``."""
        kept = columns
        for at in range(p.shape[1]):
            a, b = p[row, at], g[kept, at]
            if np.isnan(a):
                same = np.isnan(b) & (g_null[kept, at] == p_null[row, at])
            else:
                with np.errstate(invalid="ignore"):
                    same = (a == b) | (np.abs(a - b) / np.maximum(np.maximum(abs(a), np.abs(b)), 1e-9) <= tolerance)
            kept = kept[same]
        return kept

    owner, partner = np.full(len(g), -1), np.full(len(p), -1)
    for row, column in zip(np.lexsort(p.T[::-1]), np.lexsort(g.T[::-1]), strict=False):
        if len(fits(row, np.array([column]))):
            owner[column], partner[row] = row, column
    # A search that ends without a free column has seen a closed set, which no later one needs to enter.
    open_columns = np.arange(len(g))
    for start in np.flatnonzero(partner < 0):
        reached_from = np.full(len(g), -1)
        left_over, queue, end = open_columns, [start], -1
        for row in queue:
            found = fits(row, left_over)
            if not len(found):
                continue
            reached_from[found] = row
            free = found[owner[found] < 0]
            if len(free):
                end = free[0]
                break
            queue += owner[found].tolist()
            left_over = left_over[reached_from[left_over] < 0]
        if end < 0:
            open_columns = left_over
        while end >= 0:
            row = reached_from[end]
            owner[end], partner[row], end = row, end, partner[row]
    return int((owner >= 0).sum())
