"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

from . import line_dedup, mixing

CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), escaped AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '<\/turn>') AS etext,
    replace(replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '<\/turn>'), ':', '\:'), chr(10), '\' || chr(10)) AS erole
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  sum(4 + length(erole) + 2 + length(etext) + 8)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""


def _key(*parts: str) -> str:
    return "md5(" + " || '|' || ".join([f"'{mixing.SEED}'", *parts]) + ")"


def _id(col: str) -> str:
    return f"coalesce({col}::VARCHAR, 'null')"


def mixing_sql() -> str:
    d, s, cap = mixing.DIGITS, mixing.SUB_DIGITS, mixing.CAP
    levels = []
    for level in range(mixing.LEVELS):
        luck = _key(f"'node{level}'", _id("source"), "block", "epoch::VARCHAR")
        levels.append(f"""
, draws{level + 1} AS (
  SELECT source, block, turn, epoch, shard * 2 + CASE WHEN rank * 2 <= held + 1 THEN 0 ELSE 1 END AS shard FROM (
    SELECT *, row_number() OVER (PARTITION BY shard ORDER BY {luck}, source NULLS FIRST, block, epoch) AS rank, count(*) OVER (PARTITION BY shard) AS held FROM draws{level}))""")
    return rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, {_key(_id("doc_id"))} AS k FROM documents
), keyed AS (
  SELECT *, substr(k, 1, {d}) AS block, substr(k, {d + 1}, {s}) AS sub FROM sized
), blocks AS (
  SELECT source, block, sum(size)::BIGINT AS block_size FROM keyed GROUP BY ALL
), sums AS (
  SELECT source, sum(block_size)::BIGINT AS source_size FROM blocks GROUP BY source
), ranked AS (
  SELECT *, [{", ".join(map(str, mixing.WEIGHTS))}][(place % {len(mixing.WEIGHTS)} + 1)] AS weight FROM (
    SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sums)
), tried AS (
  SELECT *, ((sum(source_size) OVER () - {cap} * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (ORDER BY source_size / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level FROM ranked
), found AS (
  SELECT coalesce((SELECT level FROM tried WHERE {cap} * source_size > weight * level ORDER BY source_size / weight, place LIMIT 1), 0.0) AS level
), aimed AS (
  SELECT source, source_size, least(({cap} * source_size)::DOUBLE, weight * (SELECT level FROM found)) AS target FROM ranked
), goals AS (
  SELECT *, target - epochs * source_size AS extra FROM (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM aimed)
), ordered AS (
  SELECT b.*, g.source_size, g.target, g.epochs, g.extra, {_key(_id("b.source"), "b.block")} AS turn,
    coalesce(sum(block_size) OVER (PARTITION BY b.source ORDER BY {_key(_id("b.source"), "b.block")}, b.block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM blocks b JOIN goals g ON b.source IS NOT DISTINCT FROM g.source
), draws0 AS (
  SELECT source, block, turn, unnest(range(epochs + CASE WHEN before < extra THEN 1 ELSE 0 END)) AS epoch, 0 AS shard FROM ordered
){"".join(levels)}
, shards AS (
  SELECT source, block, list(shard ORDER BY epoch) AS shards FROM (
    SELECT o.source, o.block, o.epoch, s.shard FROM
      (SELECT source, block, epoch, row_number() OVER (PARTITION BY source ORDER BY epoch, turn, block) AS seat FROM draws{mixing.LEVELS}) o
      JOIN (SELECT source, shard, row_number() OVER (PARTITION BY source ORDER BY shard, turn, epoch) AS seat FROM draws{mixing.LEVELS}) s
      ON o.source IS NOT DISTINCT FROM s.source AND o.seat = s.seat) GROUP BY ALL
), placed AS (
  SELECT k.doc_id, k.source, k.size, o.source_size, o.target, o.epochs, o.extra, o.before, o.block_size, coalesce(h.shards, []) AS shards,
    o.before + coalesce(sum(k.size) OVER (PARTITION BY k.source, k.block ORDER BY k.sub, k.k, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto
  FROM keyed k JOIN ordered o ON k.source IS NOT DISTINCT FROM o.source AND k.block = o.block
  LEFT JOIN shards h ON k.source IS NOT DISTINCT FROM h.source AND k.block = h.block
), taken AS (
  SELECT *, epochs + CASE WHEN size = 0 THEN 0
    WHEN before < extra AND before + block_size > extra THEN CASE WHEN upto + size / 2 <= extra THEN 1 ELSE 0 END
    WHEN before < extra THEN 1 ELSE 0 END AS copies FROM placed
)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, array_to_string(shards[1:copies], ',') AS shards FROM taken
"""


def line_dedup_sql() -> str:
    return rf"""
WITH lines AS (
  SELECT doc_id, source, pos, line, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS cut FROM (
    SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
), spread AS (
  SELECT cut, min((doc_id, pos)) AS first FROM lines WHERE length(cut) > 0
  GROUP BY cut HAVING count(DISTINCT coalesce(source, chr(0))) >= {line_dedup.MIN_SITES}
), judged AS (
  SELECT l.*, s.cut IS NOT NULL AND s.first <> (l.doc_id, l.pos) AS goes FROM lines l LEFT JOIN spread s ON l.cut = s.cut
), kept AS (
  SELECT doc_id, count(*) AS n_lines, sum(goes::INT)::BIGINT AS n_removed, coalesce(string_agg(CASE WHEN NOT goes THEN line END, chr(10) ORDER BY pos), '') AS text FROM judged GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, length(coalesce(k.text, ''))::BIGINT AS kept_chars, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
"""


TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""
