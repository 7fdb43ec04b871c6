"""SQL that trains trees, level by level, as a chain of common table expressions.

It is what registered tree queries are compared with: the same rules, written
for an engine that has no trees. ``base`` names a table
``(y, w, x0, x1, ..., b_k, ...)`` with ``x`` for continuous and ``b`` for
categorical features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

#: Errors over sums of weights {w}, weighted labels {s} and squares {q}.
SQUARE = "CASE WHEN {w} <> 0 THEN {q} - {s} * {s} / {w} ELSE 0 END"
ENTROPY = "CASE WHEN {s} / {w} > 1e-10 AND {s} / {w} < 1 - 1e-10 THEN {w} * -({s} / {w} * log2({s} / {w}) + (1 - {s} / {w}) * log2(1 - {s} / {w})) ELSE 0 END"


def significant(x: str) -> str:
    """``x`` rounded to nine significant digits."""
    return f"(CASE WHEN abs({x}) < 1e-300 THEN 0 ELSE floor(({x}) * pow(10, 8 - floor(log10(abs({x}) + 1e-320))) + 0.5) / pow(10, 8 - floor(log10(abs({x}) + 1e-320))) END)"


@dataclass(frozen=True)
class Training:
    features: tuple[str, ...]
    #: Categories by id for each categorical feature, None for a continuous one.
    categories: tuple[tuple[str, ...] | None, ...]
    error: str = SQUARE
    depth: int = 4
    min_gain_fraction: float = 0.01
    trees: int = 1
    shrinkage: float = 1.0
    local: bool = False
    quantiles: int = 1000

    def _error(self, p: str) -> str:
        return "(" + self.error.format(w=f"{p}w", s=f"{p}s", q=f"{p}q") + ")"

    def _thresholds(self, name: str, rows: str) -> Iterator[str]:
        """Midpoints at the quantiles of every node's rows."""
        values = " UNION ALL ".join(f"SELECT node, {i} AS fid, x{i}::DOUBLE AS x FROM {rows}" for i, c in enumerate(self.categories) if c is None)
        yield f"{name}v AS MATERIALIZED (SELECT node, fid, list(x ORDER BY x) AS vs, count(*) AS n, least({self.quantiles}, count(*) - 1) AS cuts FROM ({values}) GROUP BY node, fid)"
        at = "trunc(i * n / (cuts + 1) - 1)::BIGINT"
        yield f"{name}t AS MATERIALIZED (SELECT DISTINCT node, fid, (vs[1 + {at}] + vs[2 + {at}]) / 2.0 AS t FROM {name}v, range(1, {self.quantiles + 1}) r(i) WHERE i <= cuts)"
        yield f"{name} AS MATERIALIZED (SELECT node, fid, list(t ORDER BY t) AS ts FROM {name}t GROUP BY node, fid)"

    def _binned(self, name: str, rows: str, q: str, on: str) -> str:
        own = [i for i, c in enumerate(self.categories) if c is None]
        bins = ", ".join(f"len(list_filter(coalesce(q{i}.ts, []), lambda t: t <= r.x{i}))::INT AS b{i}" for i in own)
        joins = " ".join(f"LEFT JOIN {q} q{i} ON q{i}.fid = {i} AND {on.format(i)}" for i in own)
        return f"{name} AS MATERIALIZED (SELECT r.* EXCLUDE ({', '.join(f'b{i}' for i in own)}), {bins} FROM {rows} r {joins})"

    def parts(self, base: str) -> Iterator[str]:
        """The expressions; the nodes of tree k are in ``t{k}_all``, and ``thresholds`` are those of all rows."""
        ids = range(len(self.features))
        blank = ", ".join(f"0 AS b{i}" for i, c in enumerate(self.categories) if c is None)
        yield f"r0 AS MATERIALIZED (SELECT *, {blank}, 1::BIGINT AS node FROM {base})"
        start = "r0"
        if not self.local:
            yield from self._thresholds("thresholds", "r0")
            yield self._binned("g0", "r0", "thresholds", "true")
            start = "g0"
        for k in range(self.trees):
            yield from self._tree(f"t{k}_", start, ids)
            if k + 1 < self.trees:
                leaf = f"SELECT r.* REPLACE (r.y - n.response AS y, 1::BIGINT AS node) FROM t{k}_r{self.depth} r JOIN t{k}_all n ON n.node_id = r.node"
                yield f"s{k} AS MATERIALIZED ({leaf})"
                start = f"s{k}"

    def _tree(self, p: str, start: str, ids: range) -> Iterator[str]:
        yield f"{p}n0 AS MATERIALIZED (SELECT 1::BIGINT AS node, count(*) AS n, sum(w) AS w, sum(w * y) AS s, sum(w * y * y) AS q FROM {start})"
        yield f"{p}least AS MATERIALIZED (SELECT {self.min_gain_fraction} * {self._error('')} AS least FROM {p}n0)"
        rows = start
        forward = "OVER (PARTITION BY node, fid ORDER BY key, bin ROWS UNBOUNDED PRECEDING)"
        backward = "OVER (PARTITION BY node, fid ORDER BY key DESC, bin DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        for level in range(self.depth):
            x = f"{p}{{}}{level}".format
            nodes = x("n")
            if self.local:
                yield f"{x('l')} AS MATERIALIZED (SELECT * FROM {rows} WHERE node >= {1 << level})"
                yield from self._thresholds(x("u"), x("l"))
                yield self._binned(x("d"), rows, x("u"), "q{0}.node = r.node")
                rows = x("d")
            cells = " UNION ALL ".join(f"SELECT node, {i} AS fid, b{i} AS bin, y, w FROM {rows} WHERE node >= {1 << level}" for i in ids)
            yield f"{x('h')} AS MATERIALIZED (SELECT c.node, fid, bin, count(*) AS n, sum(c.w) AS w, sum(c.w * y) AS s, sum(c.w * y * y) AS q FROM ({cells}) c JOIN {nodes} o ON o.node = c.node AND o.n >= 2 AND o.w >= 2 GROUP BY ALL)"
            own = [str(i) for i, c in enumerate(self.categories) if c is not None]
            yield f"{x('k')} AS MATERIALIZED (SELECT *, CASE WHEN fid IN ({', '.join(own)}) THEN CASE WHEN w <> 0 THEN s / w END ELSE bin::DOUBLE END AS key FROM {x('h')})"
            sums = ", ".join(f"sum({c}) {forward} AS l{c}, sum({c}) {backward} AS r{c}, sum({c}) OVER (PARTITION BY node, fid) AS t{c}" for c in "nwsq")
            yield f"{x('c')} AS MATERIALIZED (SELECT *, {sums}, row_number() OVER (PARTITION BY node, fid ORDER BY key, bin) - 1 AS pos, count(*) OVER (PARTITION BY node, fid) AS bins FROM {x('k')})"
            yield f"{x('e')} AS MATERIALIZED (SELECT *, {self._error('t')} AS node_error, CASE WHEN pos < bins - 1 THEN {self._error('l')} + {self._error('r')} END AS cut_error FROM {x('c')})"
            rank = f"row_number() OVER (PARTITION BY node, fid ORDER BY {significant('coalesce(cut_error, node_error)')}, cut_error IS NULL, pos)"
            yield f"{x('f')} AS MATERIALIZED (SELECT *, coalesce(cut_error, node_error) AS split_error, node_error - coalesce(cut_error, node_error) AS gain FROM (SELECT *, {rank} AS rk FROM {x('e')}) WHERE rk = 1)"
            yield f"{x('b')} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY {significant('gain')} DESC, fid) AS best FROM {x('f')}) WHERE best = 1)"
            # Gains are held against the node's own error, as it came from the parent's side.
            small = f"(b.gain <= least + 1e-7 AND b.gain <= {self._error('o.')} + 1e-7) OR b.bins < 2"
            sides = "list_sort(list(k.bin) FILTER (k.pos {} b.pos))"
            yield f"{x('s')} AS MATERIALIZED (SELECT b.node, {sides.format('<=')} AS lefts, {sides.format('>')} AS rights FROM {x('b')} b JOIN {x('c')} k ON k.node = b.node AND k.fid = b.fid GROUP BY b.node)"
            yield f"{x('m')} AS MATERIALIZED (SELECT b.*, NOT ({small}) AS split, lefts, rights FROM {x('b')} b JOIN {nodes} o ON o.node = b.node JOIN {x('s')} s ON s.node = b.node, {p}least)"
            left = "CASE " + " ".join(f"WHEN m.fid = {i} THEN " + (f"r.b{i} <= m.bin" if c is None else f"list_contains(m.lefts, r.b{i})") for i, c in enumerate(self.categories)) + " END"
            yield f"{p}r{level + 1} AS MATERIALIZED (SELECT r.* REPLACE (CASE WHEN NOT coalesce(m.split, false) THEN r.node WHEN {left} THEN 2 * r.node ELSE 2 * r.node + 1 END AS node) FROM {rows} r LEFT JOIN {x('m')} m ON m.node = r.node)"
            rows = f"{p}r{level + 1}"
            children = " UNION ALL ".join(f"SELECT 2 * node + {j} AS node, {c}n AS n, {c}w AS w, {c}s AS s, {c}q AS q FROM {x('m')} WHERE split" for j, c in enumerate("lr"))
            yield f"{p}n{level + 1} AS MATERIALIZED ({children})"
        yield f"{p}all AS MATERIALIZED ({' UNION ALL '.join(self._shown(p, level) for level in range(self.depth + 1))})"

    def _shown(self, p: str, level: int) -> str:
        """Nodes of a level in the columns of a node table; lists as text."""
        node = f"o.node::INT AS node_id, {level}::INT AS depth, o.n::BIGINT AS count, o.w::DOUBLE AS weight, {self.shrinkage} * CASE WHEN o.w <> 0 THEN o.s / o.w ELSE 0 END AS response, {self._error('o.')} AS error"
        if level == self.depth:
            return f"SELECT {node}, 0.0::DOUBLE AS split_error, 0.0::DOUBLE AS gain, NULL::INT AS feature_id, NULL::INT AS feature_type, NULL::VARCHAR AS feature, NULL::DOUBLE AS threshold, '' AS left_ids, '' AS right_ids, '' AS left_values, '' AS right_values FROM {p}n{level} o"
        kinds = " ".join(f"WHEN {i} THEN {0 if c is None else 1}" for i, c in enumerate(self.categories))
        names = " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(self.features))
        table, on = (f"{p}u{level}", " AND q.node = m.node") if self.local else ("thresholds", "")
        numbered = " OR ".join(f"m.fid = {i}" for i, c in enumerate(self.categories) if c is None)
        cut = f"CASE WHEN m.split AND ({numbered}) THEN (SELECT ts[least(m.bin + 1, len(ts))] FROM {table} q WHERE q.fid = m.fid{on}) END"
        listed = lambda side: f"CASE WHEN m.split AND NOT ({numbered}) THEN array_to_string(m.{side}, ',') ELSE '' END"
        spelled = " ".join(f"WHEN {i} THEN [" + ", ".join(f"'{v}'" for v in c) + "]" for i, c in enumerate(self.categories) if c is not None)
        worded = lambda side: f"CASE WHEN m.split AND NOT ({numbered}) THEN array_to_string(list_sort(list_transform(m.{side}, lambda b: (CASE m.fid {spelled} END)[b + 1])), ',') ELSE '' END"
        return (
            f"SELECT {node}, coalesce(m.split_error, 0.0)::DOUBLE AS split_error, coalesce(m.gain, 0.0)::DOUBLE AS gain, CASE WHEN m.split THEN m.fid END::INT AS feature_id, CASE WHEN m.split THEN CASE m.fid {kinds} END END::INT AS feature_type, "
            f"CASE WHEN m.split THEN CASE m.fid {names} END END AS feature, {cut} AS threshold, {listed('lefts')} AS left_ids, {listed('rights')} AS right_ids, {worded('lefts')} AS left_values, {worded('rights')} AS right_values "
            f"FROM {p}n{level} o LEFT JOIN {p}m{level} m ON m.node = o.node"
        )

    def sql(self, base: str, rounded=lambda x: x) -> str:
        """The whole statement; ``base`` is the expression ``base AS (...)``."""
        columns = f"node_id, depth, count, weight, {', '.join(f'{rounded(c)} AS {c}' for c in ('response', 'error', 'split_error', 'gain'))}, feature_id, feature_type, feature, threshold, left_ids, right_ids, left_values, right_values"
        trees = " UNION ALL ".join(f"SELECT {k}::INT AS tree_id, {columns} FROM t{k}_all" for k in range(self.trees))
        return f"WITH {base},\n" + ",\n".join(self.parts("base")) + f"\n{trees}"
