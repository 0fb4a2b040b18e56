"""One query per operator, over whole tables, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brackish.llm.chat import CLOSE, OPEN, PART, render_conversations
from brackish.llm.decontaminate import find_contamination
from brackish.llm.exact_dedup import duplicate_groups
from brackish.llm.filter_audit import audit_filters
from brackish.llm.hidden_markov import score_texts
from brackish.llm.license_scan import BASE, TEMPLATES, scan_licenses, template_regex
from brackish.llm.line_dedup import drop_common_lines
from brackish.llm.near_dedup import near_duplicate_groups
from brackish.llm.quality import score_quality
from brackish.llm.sentencepiece import encode_texts
from brackish.llm.structure_repair import damage, repair_conversations
from brackish.llm.text import read
from brackish.llm.token_counts import count_tokens
from brackish.llm.warc import archive_pages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: SQL for the words of a column: A-Z lower-cased, then runs of 0-9, a-z and non-ASCII.
_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


@query(
    "op3_decontamination",
    rf"""
    WITH docs AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
    items AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
    windows AS (
        SELECT item_id, unnest(list_transform(range(1, len(w) - least(len(w), 13) + 2),
                                              lambda i: array_to_string(w[i:i + least(len(w), 13) - 1], ' '))) AS passage,
               least(len(w), 13) AS n
        FROM items WHERE len(w) > 0
    ), sizes AS (SELECT DISTINCT n FROM windows),
    passages AS (
        SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS pos,
               unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS passage
        FROM docs, sizes WHERE len(w) >= n
    ), hits AS (
        SELECT doc_id, item_id, pos, n FROM passages JOIN windows USING (passage, n)
    ), found AS (
        SELECT doc_id, count(DISTINCT p) AS n_hit, count(DISTINCT item_id) AS n_items,
               array_to_string(list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))), ',') AS ids
        FROM (SELECT doc_id, item_id, unnest(range(pos, pos + n)) AS p FROM hits) GROUP BY doc_id
    )
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM docs LEFT JOIN found USING (doc_id)
    """,
)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    found = find_contamination(read(spark, folder, "documents"), read(spark, folder, "benchmark"), with_text=False)
    return found.drop("longest_match")


@query(
    "op4_exact_dedup",
    r"""
    WITH bare AS (
        SELECT doc_id, length(coalesce(text, '')) AS points,
               regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare
        FROM documents
    ), ranked AS (
        SELECT doc_id, bare,
               first_value(doc_id) OVER (PARTITION BY bare ORDER BY points DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY bare) AS group_size
        FROM bare
    )
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(bare) AS text_sha256 FROM ranked
    """,
)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return duplicate_groups(read(spark, folder, "documents"))


@query(
    "op7_line_dedup",
    r"""
    WITH lines AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
        FROM documents
    ), keyed AS (
        SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM lines
    ), common AS (
        SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
    ), marked AS (
        SELECT doc_id, line, pos, key IN (SELECT key FROM common) AS gone FROM keyed
    )
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id
    """,
)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return drop_common_lines(read(spark, folder, "documents"), with_text=False)


def _license_sql() -> str:
    """Base places word by word; the templates as regular expressions over the joined words."""
    places, labels = [], []
    for phrase, label in BASE.items():
        parts = phrase.split()
        same = " AND ".join(f"w[i + {k}] = '{part}'" for k, part in enumerate(parts))
        places.append(f"list_filter(range(1, len(w) + 1), lambda i: coalesce({same}, false))")
        labels.append(f"CASE WHEN len({places[-1]}) > 0 THEN '{label}' END")
    wording = [f"CASE WHEN regexp_matches(line, '{template_regex(t)}') THEN '{label}' END" for label, t in TEMPLATES.items()]
    listed = "list_sort(list_distinct(list_filter([{}], lambda x: x IS NOT NULL)))"
    return f"""
    WITH split AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
    found AS (
        SELECT doc_id, w, list_sort(flatten([{", ".join(places)}])) AS starts,
               {listed.format(", ".join(labels))} AS base, {listed.format(", ".join(wording))} AS accepted
        FROM (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS line FROM split)
    )
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(starts) AS BIGINT) AS n_base,
           starts[1] - 1 AS first_word, starts[-1] - 1 AS last_word, array_to_string(base, ',') AS base_labels,
           array_to_string(list_sort(list_distinct(list_concat(base, accepted))), ',') AS labels,
           CASE WHEN len(accepted) > 0 THEN 1.0 WHEN len(starts) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
    FROM found
    """


@query("op8_license_scan", _license_sql())
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(read(spark, folder, "documents")).drop("accepted")


@query(
    "op9_warc",
    """
    WITH hashed AS (
        SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
    ), first AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM hashed)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 100 AND page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 100 AND page_id <> least THEN least END AS refers_to
    FROM first
    """,
)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return archive_pages(read(spark, folder, "pages"))


@query(
    "op10_chat",
    f"""
    WITH turns AS (
        SELECT conv_id, CASE WHEN conv_id IS NOT NULL THEN turn END AS turn, coalesce(role, '') AS role,
               coalesce(text, '') AS text, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
        FROM conversations
    ), ordered AS (
        SELECT conv_id, CASE WHEN conv_id IS NULL THEN digest END AS lone, turn, role, text, digest, count(*) AS n_rows
        FROM turns GROUP BY ALL
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id, lone ORDER BY turn NULLS FIRST, digest) - 1 AS place FROM ordered
    ), talks AS (
        SELECT conv_id, lone, list(digest ORDER BY place) AS digests,
               CASE WHEN conv_id IS NULL THEN sum(n_rows) ELSE 1 END AS n_rows
        FROM placed GROUP BY conv_id, lone
    ), inner_parts AS (
        SELECT DISTINCT unnest(list_transform(range(1, len(digests)), lambda n: array_to_string(digests[1:n], ','))) AS begun FROM talks
    ), equal_talks AS (
        SELECT array_to_string(digests, ',') AS begun, min(conv_id) AS conv_id,
               CASE WHEN count(conv_id) = 0 THEN min(lone) END AS lone, max(len(digests)) AS n_turns, sum(n_rows) AS copies
        FROM talks GROUP BY ALL
    ), kept AS (SELECT * FROM equal_talks WHERE begun NOT IN (SELECT begun FROM inner_parts)),
    rendered AS (
        SELECT conv_id, lone, place // {PART} AS part,
               string_agg('{OPEN}' || replace(role, '<|im_', '<| im_') || chr(10) || replace(text, '<|im_', '<| im_')
                          || '{CLOSE}' || chr(10), '' ORDER BY place) AS rendered
        FROM placed GROUP BY ALL
    )
    SELECT kept.conv_id, CAST(part AS BIGINT) AS part, n_turns, CAST(copies AS BIGINT) AS copies,
           CAST(length(rendered) AS BIGINT) AS n_chars, sha256(rendered) AS rendered_sha256
    FROM kept JOIN rendered ON kept.conv_id IS NOT DISTINCT FROM rendered.conv_id AND kept.lone IS NOT DISTINCT FROM rendered.lone
    """,
)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    rendered = render_conversations(read(spark, folder, "conversations"))
    digest = [F.length("rendered").cast("long").alias("n_chars"), F.sha2("rendered", 256).alias("rendered_sha256")]
    return rendered.select("conv_id", "part", "n_turns", "copies", *digest)


@query("op1_token_counts")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op2_sentencepiece")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    encoded = encode_texts(read(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)
    return encoded.select("doc_id", "n_pieces", F.col("scores")[0].alias("score"), F.array_min("scores").alias("last_score"), "ids_sha256", "n_best_sha256", "round_trip")


@query("op6_quality_classifier")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return score_quality(read(spark, folder, "documents"))


@query(
    "op5_near_dedup",
    rf"""
    WITH RECURSIVE docs AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
    shingles AS (
        SELECT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                              ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
        FROM docs WHERE len(w) > 0
    ), bags AS (SELECT doc_id, s, count(*) AS n FROM shingles GROUP BY ALL),
    totals AS (SELECT doc_id, sum(n) AS total FROM bags GROUP BY doc_id),
    common AS (
        SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.n, b.n)) AS least
        FROM bags a JOIN bags b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
    ), links AS (
        SELECT x, y FROM common JOIN totals a ON a.doc_id = x JOIN totals b ON b.doc_id = y
        WHERE 5 * least >= 4 * (a.total + b.total - least)
    ), both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
    reach AS (
        SELECT doc_id, doc_id AS other FROM documents
        UNION SELECT reach.doc_id, both_ways.y FROM reach JOIN both_ways ON both_ways.x = reach.other
    ), classes AS (SELECT doc_id, min(other) AS class_id, count(*) AS class_size FROM reach GROUP BY doc_id)
    SELECT doc_id, class_id, class_size, doc_id = class_id AS kept FROM classes
    """,
)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicate_groups(read(spark, folder, "documents"))


_BLANK_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


@query(
    "op11_filter_audit",
    rf"""
    WITH plain AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
    counted AS (
        SELECT *, {_BLANK_WORDS.format("text")} AS w, min(doc_id) OVER (PARTITION BY text) AS least FROM plain
    ), marks AS (
        SELECT doc_id, max(CAST(coalesce(quality, 0) = 1 AS INT)) AS good, max(CAST(coalesce(toxic, 0) = 1 AS INT)) AS toxic
        FROM labels GROUP BY doc_id
    ), rows AS (
        SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
               CASE WHEN len(w) < 100 THEN 'A' ELSE '' END
               || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
               || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END
               || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
               || CASE WHEN coalesce(doc_id > least, false) THEN 'E' ELSE '' END AS failed
        FROM counted LEFT JOIN marks USING (doc_id)
    ), kinds AS (
        SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM rows GROUP BY ALL
    ), f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    orders AS (
        SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
        WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
    ), steps AS (
        SELECT filter_order, CAST(step AS INT) AS step, filter_order[step] AS own, filter_order[1:step - 1] AS before
        FROM orders, (SELECT unnest(range(1, 6)) AS step)
    ), each AS (
        SELECT part, filter_order, step, own, n, good, toxic, contains(failed, own) AS fails, failed = own AS alone,
               len(list_intersect(string_split(failed, ''), string_split(before, ''))) > 0 AND failed <> '' AND before <> '' AS gone
        FROM kinds, steps
    ), counted_steps AS (
        SELECT part, filter_order, step, own,
               coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS kept,
               coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS removed,
               coalesce(sum(n) FILTER (fails AND gone), 0) AS redundant,
               coalesce(sum(n) FILTER (alone), 0) AS unique_fails,
               coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS good_lost,
               coalesce(sum(toxic) FILTER (fails AND NOT gone), 0) AS toxic_lost
        FROM each GROUP BY ALL
    )
    SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
           CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
           CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
           CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
    FROM counted_steps
    """,
)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return audit_filters(read(spark, folder, "documents"), read(spark, folder, "labels"))


def _crc32(key: str) -> str:
    """SQL for the CRC-32 of an ASCII key, with the table `crc_table`."""
    codes = f"list_transform(string_split({key}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return (
        f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), "
        "lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"
    )


_CRC_TABLE = """
    crc_table AS (
        SELECT list(v ORDER BY n) AS crc FROM (
            SELECT n, list_reduce(list_prepend(n, range(8)),
                                  lambda c, b: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v
            FROM range(256) numbers(n))
    )"""


def _repair_sql() -> str:
    """Row by row through the four states; a state holds its least (cost, audit) with the repaired text."""

    def least(*ways: str) -> str:
        return f"list_sort(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))[1]"

    def step(way: str, cost: str, letter: str, line: str = "''", when: str = "true") -> str:
        return f"CASE WHEN {way} IS NOT NULL AND {when} THEN {{'c': {way}.c + {cost}, 'a': {way}.a || '{letter}', 'r': {way}.r || {line}}} END"

    user, assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"

    def closed(prefix: str) -> tuple[str, str]:
        a, b, c, d = (f"{prefix}{k}" for k in range(4))
        to_user = least(c, *[step(x, "3", "I", user) for x in (a, b, d)])
        to_assistant = least(d, step(c, "3", "I", assistant), *[step(x, "6", "II", f"{user} || {assistant}") for x in (a, b)])
        return to_user, to_assistant

    def moved(ways: tuple[str, ...], initial: str, role: str) -> list[str]:
        keep = [step(w, "open", "K", "chr(10) || role || ':' || text", f"NOT gone AND initial = '{initial}'") for w in ways]
        return keep + [step(w, "3 + open", "R", f"chr(10) || '{role}:' || text", "NOT gone") for w in ways if role]

    to_user, to_assistant = closed("s")
    after = [
        step("t0", "4", "D"),
        least(step("t1", "4", "D"), *moved(("t0",), "s", "")),
        least(step("t2", "4", "D"), *moved(("t0", "t1", "t3"), "u", "user")),
        least(step("t3", "4", "D"), *moved(("t2",), "a", "assistant")),
    ]
    last = closed("s")[1]
    return rf"""
    WITH RECURSIVE {_CRC_TABLE},
    plain AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind
        FROM conversations, crc_table
    ), damaged AS (
        SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
               CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
               unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
        FROM plain WHERE kind <> 0
    ), placed AS (
        SELECT conv_id, turn, role, text, substr(role, 1, 1) AS initial,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text), copy) AS pos
        FROM damaged
    ), judged AS (
        SELECT *, NOT regexp_matches(text, '[^ 	-
]') AS blank,
               row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
               NOT regexp_matches(text, '[.!?][ 	-
]*\z') AS cut,
               coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial NOT IN ('su', 'ua', 'au'), false) AS illegal
        FROM placed
    ), rows AS (
        SELECT *, blank OR again AS gone, CASE WHEN cut THEN 3 ELSE 0 END AS open FROM judged
    ), totals AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
               count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut AND NOT gone) AS truncated,
               count(*) FILTER (illegal) AS illegal, max(pos) AS n
        FROM rows GROUP BY conv_id
    ), walk(conv_id, pos, s0, s1, s2, s3) AS (
        SELECT conv_id, CAST(0 AS BIGINT), {{'c': CAST(0 AS BIGINT), 'a': '', 'r': ''}},
               CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, r VARCHAR)), CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, r VARCHAR)),
               CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, r VARCHAR))
        FROM totals
        UNION ALL
        SELECT conv_id, pos, {", ".join(after)}
        FROM (
            SELECT rows.*, s0 AS t0, s1 AS t1, {to_user} AS t2, {to_assistant} AS t3
            FROM walk JOIN rows ON rows.conv_id IS NOT DISTINCT FROM walk.conv_id AND rows.pos = walk.pos + 1
        )
    ), ended AS (
        SELECT walk.conv_id, gaps, blank, duplicate, truncated, illegal, {least("s0", last)} AS best
        FROM walk JOIN totals ON totals.conv_id IS NOT DISTINCT FROM walk.conv_id AND walk.pos = totals.n
    )
    SELECT all_ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
           coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost,
           coalesce(best.a, '') AS audit, sha256(coalesce(best.r[2:], '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) all_ids
    LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM all_ids.conv_id
    """


@query("op12_structure_repair", _repair_sql())
def op12(spark: SparkSession, folder: str) -> DataFrame:
    logs = read(spark, folder, "conversations")
    return repair_conversations(damage(logs), ids=logs)


@query("op13_lm_scoring")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return score_texts(read(spark, folder, "documents"))
