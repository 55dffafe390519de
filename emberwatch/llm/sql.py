"""DuckDB statements that must return the rows of the registered queries."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def near_dedup(docs: str, width: int, percent: int) -> str:
    """Statements (for a WITH clause) that end in ``near(doc_id, n_shingles, component_id, kept)`` over ``docs``."""
    words = WORDS.format(text=LOWER.format(text="text"))
    return f"""
near_words AS (SELECT doc_id, {words} AS w FROM {docs}),
near_items AS (
    SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - {width} + 2), lambda i: array_to_string(w[i:i + {width} - 1], ' ')) END)) AS item
    FROM near_words),
near_sizes AS (SELECT doc_id, count(*) AS n FROM near_items GROUP BY doc_id),
near_common AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM near_items x JOIN near_items y USING (item)
    WHERE x.doc_id < y.doc_id GROUP BY ALL),
near_links AS (
    SELECT a, b FROM near_common JOIN near_sizes p ON p.doc_id = a JOIN near_sizes q ON q.doc_id = b
    WHERE 100 * common >= {percent} * (p.n + q.n - common)),
near_reach AS (
    SELECT doc_id AS a, doc_id AS b FROM {docs}
    UNION
    SELECT r.a, l.b FROM near_reach r JOIN (SELECT a, b FROM near_links UNION ALL SELECT b, a FROM near_links) l ON l.a = r.b),
near_least AS (SELECT a AS doc_id, min(b) AS component_id FROM near_reach GROUP BY a),
near AS (
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
    FROM {docs} d JOIN near_least USING (doc_id) LEFT JOIN near_sizes USING (doc_id))"""


NEAR_DEDUP = f"WITH RECURSIVE {near_dedup('documents', 4, 80)} SELECT * FROM near"


def quality_rules(docs: str) -> str:
    """Statements for a WITH clause that end in ``rules`` over ``docs(doc_id, text)``."""
    from emberwatch.llm.quality_rules import STOP_WORDS, SYMBOLS

    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""
rule_words AS (
    SELECT doc_id, coalesce(text, '') AS text, {WORDS.format(text="text")} AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
    FROM {docs}),
rule_windows AS (
    SELECT doc_id, w, lines, text, CASE WHEN len(w) < 5 THEN []
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END AS wins
    FROM rule_words),
rule_twice AS (
    SELECT doc_id, list(pos) AS pos FROM (
        SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, win) AS n FROM (
            SELECT doc_id, unnest(range(1, len(wins) + 1)) AS pos, unnest(wins) AS win FROM rule_windows))
    WHERE n > 1 GROUP BY doc_id),
rule_repeat AS (
    SELECT doc_id, len(list_distinct(flatten(list_transform(pos, lambda p: range(p, p + 5))))) AS n FROM rule_twice),
rule_counts AS (
    SELECT r.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        len(regexp_extract_all(text, '[{SYMBOLS}]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        coalesce(p.n, 0) AS n_repeat_words, len(lines) AS n_lines,
        len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop_words
    FROM rule_windows r LEFT JOIN rule_repeat p USING (doc_id)),
rules AS (
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
        n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words
            OR word_chars::DOUBLE / n_words < 1.5 OR word_chars::DOUBLE / n_words > 20 OR n_symbols::DOUBLE / n_words > 0.1
            OR (n_stop_words + 1)::DOUBLE / n_words < 0.05 OR n_dup_lines::DOUBLE / n_lines > 0.5
            OR n_words::DOUBLE / n_lines < 2) AS kept
    FROM rule_counts)"""


def _escaped(text: str) -> str:
    from emberwatch.llm.chat_format import CONTROL

    out = f"replace({text}, '\\', '\\\\')"
    for s in CONTROL:
        out = f"replace({out}, '{s}', '{s[0]}\\{s[1:]}')"
    return out


def chat_format() -> str:
    from emberwatch.llm.chat_format import BODY, BUDGET, END, HISTORY, TURN

    marks = len(TURN) + len(BODY) + len(END)
    return f"""
WITH RECURSIVE turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
    SELECT *, ceil(length(text) / 4)::BIGINT + 4 AS tokens, row_number() OVER o AS rn,
        length({_escaped("role")}) + length({_escaped("text")}) + {marks} AS chars
    FROM turns WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text)),
led AS (
    SELECT *, sum(tokens) OVER o AS upto, lag(tokens, 1) OVER o AS t1, lag(tokens, 2) OVER o AS t2,
        lag(chars, 1) OVER o AS c1, lag(chars, 2) OVER o AS c2,
        CASE WHEN first(role) OVER o = 'system' THEN first(tokens) OVER o ELSE 0 END AS sys,
        CASE WHEN first(role) OVER o = 'system' THEN first(chars) OVER o ELSE 0 END AS sys_chars
    FROM sized WINDOW o AS (PARTITION BY conv_id ORDER BY rn ROWS UNBOUNDED PRECEDING)),
placed AS (
    SELECT *, CASE WHEN h AND rn - 2 > k AND t1 + t2 <= {HISTORY} THEN t1 + t2 WHEN h THEN t1 ELSE 0 END AS again,
        CASE WHEN h AND rn - 2 > k AND t1 + t2 <= {HISTORY} THEN c1 + c2 WHEN h THEN c1 ELSE 0 END AS again_chars
    FROM (SELECT *, (sys > 0)::INT AS k, coalesce(rn - 1 > (sys > 0)::INT AND t1 <= {HISTORY}, false) AS h FROM led)),
fitted AS (
    SELECT *, CASE WHEN tokens + again + sys <= {BUDGET} THEN again ELSE 0 END AS hist,
        CASE WHEN tokens + again + sys <= {BUDGET} THEN again_chars ELSE 0 END AS hist_chars FROM placed),
walk AS (
    SELECT conv_id, rn, 0::HUGEINT AS base, 1 AS windows, chars AS total FROM fitted WHERE rn = 1
    UNION ALL
    SELECT f.conv_id, f.rn, CASE WHEN opens THEN f.upto - f.tokens - f.hist ELSE base END,
        windows + opens::INT, total + f.chars + CASE WHEN opens THEN f.sys_chars + f.hist_chars ELSE 0 END
    FROM walk w JOIN fitted f ON f.conv_id = w.conv_id AND f.rn = w.rn + 1,
        LATERAL (SELECT f.upto - w.base > {BUDGET} - CASE WHEN w.windows > 1 THEN f.sys ELSE 0 END AS opens)),
sums AS (SELECT conv_id, arg_max(total, rn)::BIGINT AS formatted_chars FROM walk GROUP BY conv_id),
texts AS (
    SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn) AS t,
        coalesce(string_agg(text, '' ORDER BY rn) FILTER (role = 'assistant'), '') AS l FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(t) AS turns_sha256, length(l) AS loss_chars, sha256(l) AS loss_sha256, formatted_chars
FROM texts JOIN sums USING (conv_id)"""


QUALITY_RULES = f"WITH {quality_rules('documents')} SELECT * FROM rules"
CHAT_FORMAT = chat_format()


# CRC-32 byte by byte with the usual table, whose entries follow from the polynomial.
_CRC = """
crc_table AS (
    SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k:
        CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
crc AS (
    SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
        regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
    FROM (SELECT doc_id, coalesce(text, '') AS text, coalesce(octet_length(encode(text)), 0) + 1 AS size FROM documents), crc_table)"""


def sharding(shards: int) -> str:
    from emberwatch.llm.sharding import MULTIPLIER

    def jump(n: int) -> str:
        return f"""
jump{n} AS (
    SELECT doc_id, (doc_id::HUGEINT + CASE WHEN doc_id < 0 THEN 18446744073709551616 ELSE 0 END)::UHUGEINT AS k,
        -1::BIGINT AS cur, 0::BIGINT AS ahead FROM (SELECT DISTINCT doc_id FROM documents)
    UNION ALL
    SELECT doc_id, next, ahead, floor((ahead + 1) * (2147483648.0::DOUBLE / ((next // 8589934592)::DOUBLE + 1)))::BIGINT
    FROM (SELECT doc_id, ahead, (k * {MULTIPLIER} + 1) % 18446744073709551616::UHUGEINT AS next FROM jump{n} WHERE ahead < {n})),
shard{n} AS (SELECT doc_id, max(cur) AS s FROM jump{n} GROUP BY doc_id)"""

    return f"""
WITH RECURSIVE {_CRC}, {jump(shards)}, {jump(shards + 1)}
SELECT doc_id, size, text_crc32, 'key' AS law, a.s::INTEGER AS shard,
    row_number() OVER (PARTITION BY a.s ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, b.s::INTEGER AS grown_shard
FROM crc JOIN shard{shards} a USING (doc_id) JOIN shard{shards + 1} b USING (doc_id)"""


SHARDING = sharding(8)


# Checksums of decimal numbers, from the table of the usual byte-wise CRC-32.
_CRC_TABLE = """
crc_table AS (
    SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k:
        CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i))"""


def _crc(number: str) -> str:
    """Where ``crc_table`` is joined."""
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
        regexp_extract_all(hex(encode({number}::VARCHAR)), '..'), lambda h: ('0x' || h)::BIGINT)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"""


PREFIX_TRIE = f"""
WITH {_CRC_TABLE},
turns AS (
    SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations)
    WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_crc("conv_id")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM turns), crc_table),
rebuilt AS (
    SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY part, rn) AS pos FROM (
        SELECT c.conv_id, 0 AS part, t.rn, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.rn <= c.h
        UNION ALL
        SELECT c.conv_id, 1, t.rn, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.rn > c.h)),
paths AS (
    SELECT conv_id, pos AS depth, length(text) AS chars, list(struct_pack(r := role, t := text)) OVER (
        PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS prefix FROM rebuilt
    UNION ALL SELECT conv_id, 0, 0, [] FROM convs),
lengths AS (SELECT conv_id, max(depth) AS turns FROM paths GROUP BY conv_id),
nodes AS (
    SELECT depth, prefix, min(p.conv_id) AS node, count(*) AS n_convs, max(chars) AS chars,
        bool_and(depth = turns) AS childless,
        sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (depth = turns), '')) AS ends_sha256
    FROM paths p JOIN lengths USING (conv_id) GROUP BY depth, prefix),
steps AS (SELECT p.conv_id, p.depth, n.node FROM paths p JOIN nodes n ON n.depth = p.depth AND n.prefix = p.prefix),
own AS (SELECT node AS conv_id, depth, n_convs, childless, ends_sha256, (n_convs - 1) * chars AS saved FROM nodes),
sums AS (
    SELECT s.node AS conv_id, s.depth, sum(childless::INT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens
    FROM own o JOIN steps s ON s.conv_id = o.conv_id AND s.depth <= o.depth GROUP BY ALL),
parents AS (SELECT o.conv_id, o.depth, s.node AS parent FROM own o JOIN steps s ON s.conv_id = o.conv_id AND s.depth = o.depth - 1),
children AS (SELECT parent AS conv_id, depth - 1 AS depth, count(*) AS n FROM parents GROUP BY ALL)
SELECT conv_id, depth, parent AS parent_conv_id, n_convs, coalesce(n, 0) AS n_children, n_leaves, saved_tokens, ends_sha256
FROM own JOIN sums USING (conv_id, depth) LEFT JOIN parents USING (conv_id, depth) LEFT JOIN children USING (conv_id, depth)"""


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::VARCHAR))::VARCHAR || ':' || {value}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ['doc_id', 'source', 'lang', 'n_chars', text]))})"


def _levels(name: str, start: str) -> str:
    """Levels of trees: ``name(tree, level, i, n, digest)`` above ``start(tree, i, n, digest)``."""
    return f"""
{name} AS (
    SELECT tree, 0 AS level, i, n, digest FROM {start}
    UNION ALL
    SELECT tree, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY i))
    FROM {name} WHERE n > 1 GROUP BY tree, level, i // 3, n)"""


def _walk(name: str, start: str, nodes: str) -> str:
    """Ways from leaves to the tops of their trees: the digest folded so far, and the siblings met."""
    return f"""
{name} AS (
    SELECT tree, leaf, top, i, n, folded, proof, 0 AS level FROM ({start}) s(tree, leaf, top, i, n, folded, proof)
    UNION ALL
    SELECT w.tree, w.leaf, w.top, w.i // 3, (w.n + 2) // 3,
        sha256(string_agg(CASE WHEN m.i = w.i THEN w.folded ELSE m.digest END, '' ORDER BY m.i)),
        w.proof || coalesce(string_agg(m.digest, '' ORDER BY m.i) FILTER (m.i <> w.i), ''), w.level + 1
    FROM {name} w JOIN {nodes} m ON m.tree = w.top AND m.level = w.level AND m.i // 3 = w.i // 3
    WHERE w.n > 1 GROUP BY w.tree, w.leaf, w.top, w.i, w.n, w.proof, w.level)"""


MERKLE = f"""
WITH RECURSIVE {_CRC_TABLE},
rows AS (
    SELECT doc_id, coalesce('s' || source, '') AS tree, {_leaf("text")} AS leaf, {_leaf("altered")} AS other FROM (
        SELECT *, CASE WHEN {_crc("doc_id")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS altered FROM documents, crc_table)),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, other) - 1 AS i,
        count(*) OVER (PARTITION BY tree) AS n FROM rows),
starts AS (SELECT tree, i, n, leaf AS digest FROM placed),
{_levels("nodes", "starts")},
tops AS (SELECT '' AS tree, tree AS source, row_number() OVER (ORDER BY encode(tree)) - 1 AS i, count(*) OVER () AS n, digest FROM nodes WHERE n = 1),
{_levels("upper", "tops")},
{_walk("walk", "SELECT tree, i AS leaf, tree AS top, i, n, other AS folded, '' AS proof FROM placed", "nodes")},
{_walk("climb", "SELECT w.tree, w.leaf, '', t.i, t.n, w.folded, w.proof FROM walk w JOIN tops t ON t.source = w.tree WHERE w.n = 1", "upper")},
root AS (SELECT digest AS root FROM upper WHERE n = 1)
SELECT p.doc_id, p.leaf, t.digest AS subroot, root, sha256(w.proof) AS proof_sha256, w.folded AS folded_root, w.folded = root AS verified
FROM placed p JOIN tops t ON t.source = p.tree JOIN climb w ON w.tree = p.tree AND w.leaf = p.i AND w.n = 1, root"""
