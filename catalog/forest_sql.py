"""The isolation forest in SQL: draws, growth and walk as common table expressions.

The recursive parts hold one row for each tree and user, who goes down one level a step.
"""

from __future__ import annotations

from collections.abc import Sequence

SEED, SAMPLE, OVERDRAW, CONTAMINATION = 42, 256, 1.3, 0.05


def uniform(*parts: str) -> str:
    """A number in (0, 1) from the digest of ``parts``."""
    digest = f"md5(concat_ws(':', {', '.join(parts)}))"
    return f"((CAST(CAST('0x' || substr({digest}, 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0)"


def long(name: str, source: str, columns: Sequence[str], filled: bool = True) -> str:
    """user, f (position of the column), v; missing values 0."""
    value = "coalesce(CAST({} AS DOUBLE), 0)" if filled else "CAST({} AS DOUBLE)"
    values = ", ".join(value.format(c) for c in columns)
    return (
        f'{name} AS (SELECT "user", unnest(range({len(columns)})) AS f,'
        f" unnest([{values}]) AS v FROM {source})"
    )


def scaler(source: str) -> str:
    return (
        "scaler AS (SELECT f, avg(v) AS mean,"
        f" CASE WHEN stddev_pop(v) = 0 THEN 1 ELSE stddev_pop(v) END AS scale FROM {source} GROUP BY f)"
    )


def scaled(name: str, source: str) -> str:
    return f'{name} AS (SELECT "user", f, (v - mean) / scale AS v FROM {source} JOIN scaler USING (f))'


def _splits(members: str, source: str, where: str = "true") -> str:
    """The cut of every node of ``members`` in which a feature varies."""
    return f"""SELECT tree_id, node_id, f, CASE WHEN cut < hi THEN cut ELSE lo END AS cut FROM (
      SELECT *, lo + {uniform(str(SEED), 'tree_id', 'node_id', "'cut'")} * (hi - lo) AS cut FROM (
        SELECT tree_id, node_id, f, min(v) AS lo, max(v) AS hi,
          row_number() OVER (PARTITION BY tree_id, node_id ORDER BY f) - 1 AS place,
          count(*) OVER (PARTITION BY tree_id, node_id) AS varying
        FROM {members} JOIN {source} USING ("user") WHERE {where}
        GROUP BY tree_id, node_id, f HAVING min(v) < max(v)
      ) WHERE place = least(floor({uniform(str(SEED), 'tree_id', 'node_id', "'feature'")} * varying), varying - 1)
    )"""


def grown(source: str, trees: int) -> tuple[str, ...]:
    """``nodes`` of a forest over the long table ``source``."""
    share = f"least({OVERDRAW} * {SAMPLE} / n, 1)"
    draw = uniform("h", "tree_id", str(SEED))
    return (
        f"""population AS (SELECT *, CASE WHEN {share} < 1
          THEN floor(ln({uniform('h', str(SEED))}) / ln(1 - {share})) ELSE 0 END AS first_tree
        FROM (SELECT "user", md5("user") AS h, count(*) OVER () AS n FROM {source} WHERE f = 0))""",
        f"""drawn AS (SELECT "user", tree_id FROM population, range({trees}) t(tree_id)
        WHERE tree_id = first_tree OR tree_id > first_tree AND {draw} < {share}
        QUALIFY row_number() OVER (PARTITION BY tree_id
          ORDER BY md5(concat_ws(':', h, tree_id, {SEED}, 'order'))) <= {SAMPLE})""",
        "depths AS (SELECT tree_id, ceil(log2(greatest(count(*), 2))) AS deepest FROM drawn GROUP BY tree_id)",
        f"""grow(tree_id, "user", node_id, depth) AS (
        SELECT tree_id, "user", 1, 0 FROM drawn
        UNION ALL
        SELECT tree_id, "user", 2 * node_id + CAST(v > cut AS INTEGER), depth + 1
        FROM grow JOIN ({_splits('grow JOIN depths USING (tree_id)', source, 'depth < deepest')})
          USING (tree_id, node_id) JOIN {source} USING ("user", f))""",
        f"""splits AS (
        {_splits('grow JOIN depths USING (tree_id)', source, 'depth < deepest')})""",
        """nodes AS (
        SELECT tree_id, node_id, depth, coalesce(f, -1) AS feature, coalesce(cut, 0) AS threshold, size
        FROM (SELECT tree_id, node_id, depth, count(*) AS size FROM grow GROUP BY ALL)
        LEFT JOIN splits USING (tree_id, node_id))""",
    )


def walked(name: str, source: str, trees: int, sample: str) -> tuple[str, ...]:
    """``name``: user and score of the long table ``source`` under ``nodes``."""
    path = (
        "CASE WHEN {0} > 2 THEN 2 * (ln({0} - 1) + 0.5772156649015329) - 2 * ({0} - 1) / CAST({0} AS DOUBLE)"
        " WHEN {0} = 2 THEN 1 ELSE 0 END"
    )
    scale = path.format(f"least({SAMPLE}, {sample})")
    return (
        f"""{name}_walk(tree_id, "user", node_id) AS (
        SELECT t.tree_id, "user", 1 FROM {source}, range({trees}) t(tree_id) WHERE f = 0
        UNION ALL
        SELECT w.tree_id, w."user", 2 * w.node_id + CAST(v > threshold AS INTEGER)
        FROM {name}_walk w JOIN nodes n ON n.tree_id = w.tree_id AND n.node_id = w.node_id AND n.feature >= 0
        JOIN {source} x ON x."user" = w."user" AND x.f = n.feature)""",
        f"""{name} AS (
        SELECT "user", round(-pow(2, -sum(depth + {path.format('size')}) / {trees} / ({scale})), 12) AS score
        FROM {name}_walk JOIN nodes USING (tree_id, node_id) WHERE feature < 0 GROUP BY "user")""",
    )


def model(source: str, columns: Sequence[str], trees: int) -> tuple[str, ...]:
    """Scaler, forest and offset fitted on the table ``source``."""
    return (
        long("model_raw", source, columns),
        scaler("model_raw"),
        scaled("model_rows", "model_raw"),
        *grown("model_rows", trees),
        *walked("model_scores", "model_rows", trees, f"(SELECT count(*) FROM {source})"),
        f"cutoff AS (SELECT quantile_cont(score, {CONTAMINATION}) AS bound FROM model_scores)",
    )


def decided(name: str, source: str, columns: Sequence[str], trained: str, trees: int) -> tuple[str, ...]:
    """``name``: user and decision of the table ``source`` under the model."""
    return (
        long(f"{name}_raw", source, columns),
        scaled(f"{name}_rows", f"{name}_raw"),
        *walked(f"{name}_scores", f"{name}_rows", trees, f"(SELECT count(*) FROM {trained})"),
        f'{name} AS (SELECT "user", score - bound AS decision FROM {name}_scores, cutoff)',
    )


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)
