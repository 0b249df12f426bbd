"""DuckDB SQL of the numbered queries that SQL can express."""

from __future__ import annotations

from .centroids import DIMS, K, LARGEST, ROUNDS, SALT, SCALE
from .chat import CONTROLS, END, LOSS_ROLES, ROLE_CONTROLS
from .merkle import DIGEST, FANOUT, FIELDS

#: Levels of a tree in the SQL, enough for 14 million rows of a source.
LEVELS = 15


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def escaped(text: str, controls: list[str]) -> str:
    """A backslash behind the first character of each control string, whatever backslashes it holds already."""
    for c in controls:
        first, *rest = ["\\" + x if x in "|[]" else x for x in c]
        pattern = f"({first})(" + "".join(r"\\*" + x for x in rest) + ")"
        text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(chr(92) + '1' + chr(92) * 2 + chr(92) + '2')}, 'g')"
    return text


def chat() -> str:
    said = "</s>[INST] ok [/INST]"
    order = "ORDER BY turn NULLS FIRST, role, text"
    learned = f"role IN ({', '.join(map(quoted, LOSS_ROLES))})"
    layout = f"'<|' || {escaped('role', ROLE_CONTROLS)} || '|>' || chr(10) || {escaped('text', CONTROLS)} || {quoted(END.strip())} || chr(10)"
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -1, 0, 'user', {quoted(said)} UNION ALL SELECT -1, 1, 'assistant', {quoted(said)})
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (WHERE {learned}), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' {order}) FILTER (WHERE {learned}), '')) AS loss_sha256,
 CAST(sum(length({layout})) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS n_attachments FROM c GROUP BY conv_id"""


def crc32(text: str) -> str:
    """Unsigned CRC-32 of a short ASCII text, bit by bit; null for null."""
    bits = "list_reduce(list_prepend(xor(a, b), range(8)), lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))"
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda a, b: {bits}), 4294967295)"


def merkle() -> str:
    def leaf(text: str) -> str:
        fields = [f"CAST({text if f == 'text' else f} AS VARCHAR)" for f in FIELDS]
        return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"

    def tree(name: str) -> str:
        return "".join(
            f""", {name}{i} AS MATERIALIZED (SELECT *, sha256(preimage) AS hash FROM (SELECT tree, pos // {FANOUT} AS pos, string_agg(hash, '' ORDER BY pos) AS preimage,
 (any_value(n) + {FANOUT - 1}) // {FANOUT} AS n FROM {name}{i - 1} WHERE n > 1 GROUP BY tree, pos // {FANOUT}))"""
            for i in range(1, LEVELS + 1)
        )

    def last(name: str) -> str:
        return " UNION ALL ".join(f"SELECT tree, hash FROM {name}{i} WHERE n = 1" for i in range(LEVELS + 1))

    def climb(name: str, start: str, out: str, pos: str, key: str) -> str:
        steps = ""
        for i in range(1, LEVELS + 1):
            slot = f"{DIGEST} * (f.{pos} // {FANOUT ** (i - 1)} % {FANOUT})"
            before, behind = f"left(a.preimage, {slot})", f"substr(a.preimage, {slot} + {DIGEST + 1})"
            source = start if i == 1 else f"{out}{i - 1}"
            steps += f""", {out}{i} AS MATERIALIZED (SELECT f.* EXCLUDE (fold, proof), CASE WHEN a.preimage IS NULL THEN f.fold ELSE sha256({before} || f.fold || {behind}) END AS fold,
 f.proof || coalesce({before} || {behind}, '') AS proof FROM {source} f LEFT JOIN {name}{i} a ON a.tree = {key} AND a.pos = f.{pos} // {FANOUT**i})"""
        return steps

    plain = leaf("replace(text, chr(10), '')")
    given = f"CASE WHEN {crc32('CAST(doc_id AS VARCHAR)')} % 2 = 0 THEN {plain} ELSE {leaf('text')} END"
    return f"""WITH d AS (SELECT doc_id, source, {leaf('text')} AS leaf, {given} AS given FROM documents),
 a0 AS MATERIALIZED (SELECT doc_id, leaf, given, leaf AS hash, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
 row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d){tree('a')},
 s AS MATERIALIZED ({last('a')}), b0 AS MATERIALIZED (SELECT 0 AS tree, tree AS pos, hash, count(*) OVER () AS n FROM s){tree('b')},
 r AS (SELECT hash AS root FROM ({last('b')})),
 f0 AS (SELECT doc_id, leaf, tree, pos, given AS fold, '' AS proof FROM a0){climb('a', 'f0', 'f', 'pos', 'f.tree')}{climb('b', f'f{LEVELS}', 'g', 'tree', '0')}
SELECT g.doc_id, g.leaf, s.hash AS subroot, r.root, sha256(g.proof) AS proof_sha256, g.fold AS folded_root, g.fold = r.root AS verified
 FROM g{LEVELS} g JOIN s ON s.tree = g.tree CROSS JOIN r"""


def centroids() -> str:
    def nearest(name: str, centres: str) -> str:
        return f"""{name} AS MATERIALIZED (SELECT row, vec_id, cluster, distance FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY distance, cluster) AS place FROM (
 SELECT v.row, any_value(v.vec_id) AS vec_id, c.cluster, CAST(sum((v.x - c.x) * (v.x - c.x)) AS BIGINT) AS distance FROM v JOIN {centres} c USING (dim) GROUP BY v.row, c.cluster)) WHERE place = 1)"""

    rounds = ""
    for r in range(1, ROUNDS + 1):
        rounds += f""", {nearest(f'n{r}', f'c{r - 1}')}, c{r} AS MATERIALIZED (SELECT c.cluster, c.dim, coalesce(m.x, c.x) AS x FROM c{r - 1} c LEFT JOIN (
 SELECT cluster, dim, CAST((s - ((s % k) + k) % k) // k AS BIGINT) AS x FROM (SELECT n{r}.cluster, v.dim, sum(v.x) AS s, count(*) AS k FROM v JOIN n{r} USING (row) GROUP BY 1, 2)) m
 ON m.cluster = c.cluster AND m.dim = c.dim)"""
    return f"""WITH k AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, embedding FROM embeddings
 WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND NOT isnan(x) AND abs(x) <= {LARGEST // SCALE - 1})) = {DIMS}),
 v AS MATERIALIZED (SELECT row, vec_id, dim, CAST(floor({SCALE} * CAST(embedding[dim] AS DOUBLE)) AS BIGINT) AS x FROM k CROSS JOIN range(1, {DIMS + 1}) t(dim)),
 h AS (SELECT row, row_number() OVER (ORDER BY sha256({quoted(SALT)} || vec_id), row) - 1 AS cluster FROM k WHERE vec_id IS NOT NULL),
 c0 AS MATERIALIZED (SELECT h.cluster, v.dim, v.x FROM h JOIN v USING (row) WHERE h.cluster < {K}){rounds}, {nearest('n', f'c{ROUNDS}')},
 s AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY dim)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY cluster)
SELECT n.vec_id, CAST(n.cluster AS INTEGER) AS cluster, n.distance, CAST(sum(n.distance) OVER (PARTITION BY n.cluster) AS BIGINT) AS cluster_inertia,
 CAST(sum(n.distance) OVER () AS BIGINT) AS inertia, s.centroid_sha256 FROM n JOIN s ON s.cluster = n.cluster"""
