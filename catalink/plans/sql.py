"""SQL for DuckDB that gives the rows of the registered queries, written without the operators' shortcuts."""

from __future__ import annotations

from catalink.functions.text import GENERIC_TITLES, SPACES, STOPWORDS


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def clean(x: str) -> str:
    t = f"lower(replace(replace(replace(coalesce({x}, ''), '_', ' '), '-', ' '), '&', ' and '))"
    t = rf"regexp_replace(replace({t}, ' n ', ' and '), '[^\p{{L}}\p{{N}}{SPACES}]', '', 'g')"
    return f"trim(regexp_replace({t}, '[{SPACES}]+', ' ', 'g'))"


def words(c: str, least: int = 4) -> str:
    return f"list_distinct(list_filter(string_split({c}, ' '), lambda w: len(w) >= {least} AND NOT list_contains({_list(STOPWORDS)}, w)))"


def strip_code(c: str) -> str:
    return rf"trim(regexp_replace({c}, '^tsr\p{{Nd}}+ *', ''))"


def strip_any(c: str) -> str:
    return rf"trim(regexp_replace({c}, '^tsr[\p{{L}}\p{{N}}_]* *', ''))"


def verbatim(title: str, text: str) -> str:
    return f"(len({words(title)}) >= 3 AND NOT list_contains({_list(GENERIC_TITLES)}, {title}) AND contains({text}, {title}))"


FILES = f"""
f0 AS MATERIALIZED (SELECT doc_id AS file_id, {clean('text')} AS text, CAST(ceil(n_chars / 2000) AS INT) AS page_count FROM documents),
files AS MATERIALIZED (SELECT *, {words('text')} AS words, CASE WHEN page_count % 2 = 0 THEN 30000.0 ELSE 130000.0 END AS bpp FROM f0)"""
ENTRIES = f"""
e0 AS MATERIALIZED (SELECT item_id, {clean('text')} AS clean_notes,
  text || ' ' || CAST(item_id % 3 + 10 AS VARCHAR) || ' pages' || CASE WHEN item_id % 2 = 0 THEN ' in color' ELSE '' END AS notes FROM benchmark),
entries AS MATERIALIZED (SELECT *, {words('clean_notes')} AS words, array_to_string(list_slice(string_split(clean_notes, ' '), 1, 6), ' ') AS core_title FROM e0)"""
IDF = """
ew AS (SELECT item_id, len(words) AS n, unnest(words) AS word FROM entries),
idf AS MATERIALIZED (SELECT word, ln((SELECT count(*) FROM entries) / count(*)) + 1 AS idf FROM ew GROUP BY word)"""
OVERLAP = """
ei AS MATERIALIZED (SELECT item_id, word, idf, sum(idf) OVER (PARTITION BY item_id) AS whole FROM ew JOIN idf USING (word) WHERE n >= 20),
fw AS (SELECT file_id, unnest(words) AS word FROM files),
overlap AS MATERIALIZED (SELECT file_id, item_id, round(sum(idf) / any_value(whole), 9) AS overlap FROM fw JOIN ei USING (word) GROUP BY ALL)"""
BASE = f"WITH {FILES}, {ENTRIES}, {IDF}, {OVERLAP}"


def best(pairs: str, score: str = "overlap", default: str = "0", direction: str = "DESC") -> str:
    return f"""(SELECT file_id, max(CASE WHEN k = 1 THEN item_id END) AS item_id, max(CASE WHEN k = 1 THEN {score} END) AS score,
  coalesce(max(CASE WHEN k = 2 THEN {score} END), {default}) AS runner_up
  FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY {score} {direction}, item_id) AS k FROM {pairs}) WHERE k <= 2 GROUP BY file_id)"""


COLOUR = "(contains(lower(notes), 'color') OR contains(lower(notes), 'colour'))"
PAGED = r"list_contains(list_transform(regexp_extract_all(lower(notes), '(\d{2,3})[\s-]?page', 1), lambda x: CAST(x AS INT)), page_count)"
CATALOG = f"""
c0 AS (SELECT item_id, words, notes, 'TSR' || CAST(item_id + 2000 AS VARCHAR) || ': ' || core_title || CASE WHEN item_id % 5 = 1 THEN ' record sheets' WHEN item_id % 11 = 3 THEN ' monster manual' ELSE '' END AS title FROM entries),
c1 AS (SELECT *, {clean('title')} AS clean_title, item_id % 13 <> 4 AS is_document FROM c0),
catalog_ AS MATERIALIZED (SELECT *, {strip_code('clean_title')} AS core_title, replace(title, ':', ' -') AS display_name, contains(clean_title, 'record sheet') AS blank,
  contains(clean_title, 'record sheet') OR contains(clean_title, 'monster manual') OR item_id % 7 = 2 AS out_ FROM c1),
named AS MATERIALIZED (SELECT f.*, coalesce(c.clean_title, '') AS clean_name FROM files f LEFT JOIN catalog_ c ON c.item_id = f.file_id % 40),
crossed_ AS (SELECT f.file_id, c.item_id, o.overlap, f.clean_name, len(f.words) AS n_words, c.clean_title, c.blank, c.out_, c.display_name,
    CASE WHEN page_count > 0 AND {PAGED} THEN 0.3 ELSE 0 END::DOUBLE AS page, CASE WHEN {verbatim('c.core_title', 'f.text')} THEN 0.2 ELSE 0 END::DOUBLE AS titled,
    CASE WHEN {COLOUR} AND bpp > 120000 THEN 0.1 WHEN NOT {COLOUR} AND bpp > 0 AND bpp < 40000 THEN 0.05 ELSE 0 END::DOUBLE AS density
  FROM named f CROSS JOIN catalog_ c LEFT JOIN overlap o ON o.file_id = f.file_id AND o.item_id = c.item_id WHERE c.is_document),
scored_ AS MATERIALIZED (SELECT *, round(coalesce(overlap, 0) + page + density + titled, 9) AS score FROM crossed_ WHERE overlap IS NOT NULL OR page > 0 OR titled > 0),
fit AS (SELECT * EXCLUDE (score), score FROM scored_ WHERE NOT out_ OR clean_title = clean_name)"""
CONTENT = f"{CATALOG}, content AS MATERIALIZED (SELECT * FROM {best('fit', 'score')} WHERE score >= 0.9 AND round(score - runner_up, 9) >= 0.2)"
SHA = "d AS MATERIALIZED (SELECT doc_id, source, n_chars, sha256(text) AS sha FROM documents)"
UNCLAIMED = f"""{CONTENT},
claimed_ AS (SELECT display_name FROM content JOIN catalog_ USING (item_id)),
pool AS (SELECT * FROM scored_ WHERE NOT out_ AND n_words > 0 AND file_id NOT IN (SELECT file_id FROM content) AND display_name NOT IN (SELECT display_name FROM claimed_)),
unclaimed AS MATERIALIZED (SELECT * FROM {best('pool', 'score')} WHERE score >= 0.3 AND score > runner_up)"""
PARTS = f"""
p0 AS (SELECT p_partkey AS pos,
  CASE WHEN p_partkey % 7 = 0 THEN 'TSRXXXX: ' ELSE 'TSR' || CAST(p_partkey % 5 + 2000 AS VARCHAR) || ': ' END || p_name || CASE WHEN p_partkey % 7 = 0 THEN '' ELSE ' ' || p_brand END AS title,
  p_type || ' ' || p_size || ' pages' AS notes, CAST(p_size + 1970 AS VARCHAR) AS year,
  CASE WHEN p_partkey % 11 = 0 THEN p_name || ' art.lnk' ELSE 'f' || p_partkey || '.pdf' END AS base FROM part),
p1 AS (SELECT *, {clean('title')} AS clean_title, {clean("regexp_replace(base, '[.][^.]*$', '')")} AS application_clean, NOT base LIKE '%.lnk' AS is_document FROM p0),
parts AS MATERIALIZED (SELECT *, {strip_code('clean_title')} AS core_title, {strip_any('clean_title')} AS bare FROM p1)"""
IMAGES = f"""
i0 AS (SELECT p_partkey AS pos, 'TSR' || CAST(p_size % 5 + 2000 AS VARCHAR) || ' ' || p_name || ' ' || p_brand AS original_name FROM part),
i1 AS (SELECT *, {clean('original_name')} AS clean_name FROM i0),
images AS MATERIALIZED (SELECT *, {strip_code('clean_name')} AS core_name FROM i1)"""
NAMES = f"names AS MATERIALIZED (SELECT min(p_partkey) AS name_id, {clean('p_name')} AS clean_name, max(p_size) AS page_count FROM part GROUP BY p_name)"
LATEST = "SELECT * FROM events WHERE {} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"


def oracles() -> dict[str, str]:
    colour, paged = COLOUR, PAGED
    tokens = f"list_filter(string_split(clean_name, ' '), lambda w: len(w) > 1 AND NOT list_contains({_list(STOPWORDS)}, w))"
    bits = " + ".join(f"CAST((a.embedding[{i}] > 0) <> (b.embedding[{i}] > 0) AS BIGINT)" for i in range(1, 65))
    found = {
        "clean_text": f"""SELECT origin, id, md5(c) AS digest, CAST(len(c) AS BIGINT) AS n_chars FROM (
            SELECT 'documents' AS origin, doc_id AS id, {clean('text')} AS c FROM documents UNION ALL SELECT 'pages', page_id, {clean('html')} FROM pages)""",
        "strip_codes": f"""SELECT p_partkey, c AS clean_title, {strip_code('c')} AS core_title, {strip_any('c')} AS bare_title FROM (
            SELECT p_partkey, {clean("CASE p_partkey % 3 WHEN 0 THEN 'TSR' || p_partkey || ': ' WHEN 1 THEN 'TSRXXXX: ' ELSE '' END || p_name")} AS c FROM part)""",
        "token_idf": f"WITH {ENTRIES}, {IDF} SELECT word, round(idf, 6) AS idf FROM idf",
        "overlap_scores": f"{BASE} SELECT file_id, item_id, round(overlap, 6) AS overlap FROM overlap",
        "content_match": f"{BASE}, {CONTENT} SELECT file_id, item_id, round(score, 6) AS score, round(runner_up, 6) AS runner_up FROM content",
        "bonus_candidates": f"""{BASE},
            crossed AS (SELECT file_id, item_id, text, notes, core_title, page_count, bpp, CASE WHEN page_count > 0 AND {paged} THEN 0.3 ELSE 0 END::DOUBLE AS page,
              CASE WHEN {verbatim('core_title', 'text')} THEN 0.2 ELSE 0 END::DOUBLE AS titled FROM files, entries),
            scored AS (SELECT c.file_id, c.item_id, overlap, page, titled,
              CASE WHEN {colour} AND bpp > 120000 THEN 0.1 WHEN NOT {colour} AND bpp > 0 AND bpp < 40000 THEN 0.05 ELSE 0 END::DOUBLE AS density
              FROM crossed c LEFT JOIN overlap o ON o.file_id = c.file_id AND o.item_id = c.item_id)
            SELECT file_id, item_id, round(round(coalesce(overlap, 0) + page + density + titled, 9), 6) AS score FROM scored WHERE overlap IS NOT NULL OR page > 0 OR titled > 0""",
        "verbatim_title": f"WITH {FILES}, {ENTRIES} SELECT file_id, item_id FROM files, entries WHERE {verbatim('core_title', 'text')}",
        "unclaimed_match": f"{BASE}, {UNCLAIMED} SELECT file_id, item_id, round(score, 6) AS score FROM unclaimed",
        "blank_pool_match": f"""{BASE}, {CATALOG}, forms AS (SELECT * FROM scored_ WHERE blank)
            SELECT file_id, item_id, round(score, 6) AS score, round(runner_up, 6) AS runner_up FROM {best('forms', 'score')} WHERE score >= 0.5 AND round(score - runner_up, 9) >= 0.4""",
        "cascade_labels": f"{BASE}, {CONTENT} SELECT file_id, display_name AS target_title, 'Content Match (score #, next #)' AS method FROM content JOIN catalog_ USING (item_id)",
        "text_flags": """WITH p AS (SELECT p_partkey, p_partkey % 4 AS k, p_partkey % 3 AS m, CASE WHEN p_partkey % 5 = 0 THEN '.' ELSE '' END || p_name AS stem, p_name, CASE WHEN p_partkey % 2 = 0 THEN '.gz' ELSE '' END AS ext FROM part)
            SELECT p_partkey, k IN (0, 3) AS is_blank, k = 1 AS is_hub,
              p_name || CASE k WHEN 0 THEN ' Record Sheets' WHEN 1 THEN ' Monster-Manual' WHEN 2 THEN ' Map' ELSE 'Hex Pad' END || '.pdf' AS file_name,
              CASE m WHEN 0 THEN 'Catalog Name' WHEN 1 THEN 'Filename Tokens (12 pages)' ELSE 'Content Match' END AS method, stem || CASE WHEN ext <> '' THEN '.tar' ELSE '' END AS stem, ext FROM p""",
        "refused_plans": """WITH p AS (SELECT p_partkey AS i, 'f' || p_partkey AS stem FROM part WHERE p_partkey % 3 <> 0),
            t AS (SELECT *, CASE WHEN i % 7 = 0 THEN 'both ' || CAST(i // 14 AS VARCHAR) WHEN i % 5 = 0 THEN 'f' || CAST(i + 1 AS VARCHAR) || '?' WHEN i % 11 = 0 THEN stem ELSE 'own ' || i END AS t FROM p),
            c AS (SELECT *, count(*) OVER (PARTITION BY t) AS n FROM t),
            s AS (SELECT *, n = 1 AND t LIKE 'f%?' AND i + 1 IN (SELECT i FROM p) AS stays FROM c)
            SELECT i AS file_id, CASE WHEN n = 1 AND NOT stays THEN t END AS target_title,
              CASE WHEN n > 1 THEN 'Skipped -> ' || n || ' files in this batch all matched ' || chr(39) || t || chr(39) || ' - ambiguous, left for manual review'
                   WHEN stays THEN 'Skipped -> matches the current name of a different file staying in place (' || chr(39) || t || chr(39) || ') - ambiguous, left for manual review' ELSE 'm' END AS match_method FROM s""",
        "suffix_numbering": """WITH p AS (SELECT p_partkey AS pos, p_name, min(p_partkey) OVER (PARTITION BY p_name) AS first_ FROM part),
            q AS (SELECT *, pos = first_ AND pos % 2 = 0 AS right_, pos % 9 <> 0 OR pos = first_ AS wants FROM p),
            r AS (SELECT *, row_number() OVER (PARTITION BY p_name, wants ORDER BY NOT right_, pos) AS k FROM q)
            SELECT pos, CASE WHEN right_ THEN p_name || '.pdf' ELSE 'f' || pos || '.pdf' END AS old,
              CASE WHEN wants THEN p_name || CASE WHEN k > 1 THEN ' (' || k || ')' ELSE '' END || '.pdf' END AS new FROM r""",
        "hamming_match": f"""WITH pairs AS (SELECT a.vec_id AS file_id, b.vec_id AS item_id, {bits} AS distance FROM embeddings a, embeddings b
              WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
            SELECT file_id, item_id, score AS distance, CAST(runner_up AS BIGINT) AS runner_up, score <= 20 AND runner_up - score >= 3 AS accepted FROM {best('pairs', 'distance', '999', 'ASC')}""",
        "shingle_candidates": f"""WITH {FILES}, {ENTRIES},
            fs AS (SELECT DISTINCT file_id, s FROM (SELECT file_id, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' '))) AS s FROM (SELECT file_id, string_split(text, ' ') AS w FROM files))),
            es AS (SELECT DISTINCT item_id, s FROM (SELECT item_id, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' '))) AS s FROM (SELECT item_id, string_split(clean_notes, ' ') AS w FROM entries)))
            SELECT file_id, item_id, count(*) AS shared FROM fs JOIN es USING (s) GROUP BY ALL""",
        "fingerprint_join": f"""WITH {SHA}, cache AS (SELECT sha, min(doc_id) AS m FROM d WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY sha)
            SELECT doc_id AS file_id, 'title ' || m AS target_title, 'Fingerprint Cache: m' AS match_method FROM d JOIN cache USING (sha) WHERE m % 7 <> 0""",
        "duplicate_groups": f"""WITH {SHA},
            n AS (SELECT source || ' ' || CAST(doc_id // 80 AS VARCHAR) AS base, (doc_id // 20) % 4 + 1 AS k, sha FROM d),
            grouped AS (SELECT base, count(*) AS members, count(DISTINCT sha) AS distinct_hashes, bool_or(k = 1) AS plain, bool_or(k > 1) AS numbered FROM n GROUP BY base)
            SELECT base, members, distinct_hashes, distinct_hashes = 1 AS is_identical FROM grouped WHERE plain AND numbered""",
        "duplicate_targets": f"{BASE}, {UNCLAIMED} SELECT file_id, item_id AS target_title, count(*) OVER (PARTITION BY item_id) > 1 AS is_duplicate FROM unclaimed",
        "sibling_flags": f"""WITH {PARTS} SELECT pos, title LIKE 'TSRXXXX:%' AND bare <> '' AND EXISTS (
            SELECT 1 FROM (SELECT DISTINCT bare AS b FROM parts WHERE title NOT LIKE 'TSRXXXX:%') o WHERE starts_with(o.b, parts.bare || ' ')) AS has_specific_sibling FROM parts""",
        "display_name": f"""WITH {PARTS}, {IMAGES},
            app AS (SELECT clean_name AS c, min_by(original_name, pos) AS v FROM images GROUP BY 1),
            core AS (SELECT core_name AS c, min_by(original_name, pos) AS v FROM images GROUP BY 1),
            code AS (SELECT core_name AS c, string_split(clean_name, ' ')[1] AS l, min_by(original_name, pos) AS v FROM images GROUP BY 1, 2),
            titles AS (SELECT DISTINCT core_title AS t FROM parts WHERE core_title <> ''),
            inside AS (SELECT t AS c, min_by(original_name, pos) AS v FROM titles JOIN images ON contains(clean_name, t) GROUP BY 1)
            SELECT p.pos, coalesce(CASE WHEN p.application_clean <> '' THEN app.v END, CASE WHEN core.v IS NOT NULL THEN coalesce(code.v, core.v) END, inside.v, replace(p.title, ':', ' -')) AS display_name
            FROM parts p LEFT JOIN app ON app.c = p.application_clean LEFT JOIN core ON core.c = p.core_title
            LEFT JOIN code ON code.c = p.core_title AND code.l = string_split(p.clean_title, ' ')[1] LEFT JOIN inside ON inside.c = p.core_title""",
        "ambiguous_titles": f"""WITH {PARTS},
            named AS (SELECT *, title || ' #' || year AS display_name FROM parts WHERE is_document),
            g AS (SELECT core_title, min(pos) AS first, list_sort(list(DISTINCT display_name)) AS names, count(*) AS n FROM named GROUP BY 1 HAVING n >= 2 AND len(names) >= 2),
            u AS (SELECT first, names, unnest(names) AS display_name FROM g),
            o AS (SELECT display_name, max_by(names, first) AS names FROM u GROUP BY 1)
            SELECT display_name, CAST(len(names) AS BIGINT) AS n_names, md5(array_to_string(list_filter(names, lambda x: x <> display_name), '; ')) AS others_digest FROM o""",
        "legacy_token": f"""WITH {PARTS}, {NAMES}, t AS (SELECT *, {tokens} AS t FROM names),
            pairs AS (SELECT name_id, pos, clean_title = clean_name AS self, contains(notes, CAST(page_count AS VARCHAR)) AS paged, year FROM t, parts
              WHERE len(t) >= 2 AND contains(clean_title, t[1]) AND contains(clean_title, t[2])),
            g AS (SELECT name_id, count(*) AS n, min(pos) AS only_, min(pos) FILTER (self) AS s, min(pos) FILTER (paged) AS p, arg_max(pos, (year, pos)) AS l FROM pairs GROUP BY 1)
            SELECT name_id, CASE WHEN n = 1 THEN only_ ELSE coalesce(s, p, l) END AS pos,
              CASE WHEN n = 1 THEN 'unique' WHEN s IS NOT NULL THEN 'self' WHEN p IS NOT NULL THEN 'pages' ELSE 'latest' END AS rule FROM g""",
        "substring_names": f"""WITH {IMAGES}, {NAMES} SELECT name_id, min(pos) AS pos FROM names n, images i
            WHERE len(n.clean_name) >= 4 AND (contains(i.clean_name, n.clean_name) OR contains(n.clean_name, i.clean_name)) GROUP BY 1""",
        "nonpdf_longest": f"""WITH {PARTS}, {NAMES}, s AS (SELECT * FROM parts WHERE NOT is_document), n AS (SELECT * FROM names WHERE len(clean_name) >= 4),
            exact AS (SELECT name_id, min(pos) AS pos FROM n JOIN s ON clean_name IN (clean_title, core_title, application_clean) GROUP BY 1 HAVING count(*) = 1),
            near AS (SELECT name_id, pos, rank() OVER (PARTITION BY name_id ORDER BY len(clean_title) DESC) AS k FROM n, s
              WHERE clean_title <> '' AND (contains(clean_title, clean_name) OR contains(clean_name, clean_title)) AND name_id NOT IN (SELECT name_id FROM exact)),
            longest AS (SELECT name_id, min(pos) AS pos FROM near WHERE k = 1 GROUP BY 1 HAVING count(*) = 1)
            SELECT * FROM exact UNION ALL SELECT * FROM longest""",
        "claimed_setops": f"""{BASE}, {CONTENT}, c AS (SELECT item_id FROM content UNION SELECT doc_id FROM documents WHERE doc_id % 2 = 0)
            SELECT item_id, item_id IN (SELECT item_id FROM c) AS claimed FROM benchmark""",
        "incremental_partition": f"""WITH {SHA}, cache AS (SELECT sha, min(doc_id) AS m FROM d GROUP BY 1)
            SELECT 'f' || doc_id AS file_name, CASE WHEN ok THEN 'title ' || m END AS title, ok AS skip
            FROM (SELECT doc_id, m, doc_id % 3 <> 0 AND doc_id % 5 <> 0 AND m % 7 <> 0 AS ok FROM d JOIN cache USING (sha))""",
        "cache_merge": f"""WITH old AS ({LATEST.format('event_id % 4 = 0')}),
            rows_ AS (SELECT user_id, event_type, event_id, 0 AS k, -event_id AS p FROM events WHERE event_id % 97 = 2
              UNION ALL SELECT user_id, event_type, event_id, 1, 0 FROM old UNION ALL SELECT user_id, event_type, event_id, 2, event_id FROM events WHERE event_id % 4 <> 0 AND event_id % 97 <> 2)
            SELECT 'u' || user_id AS sha256, event_type || ' ' || event_id AS title, event_type AS matched_via FROM rows_ QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k, p) = 1""",
        "index_merge": f"""WITH idx AS ({LATEST.format('event_id % 2 = 0')}), r AS ({LATEST.format('event_id % 2 = 1')}), sure AS (SELECT * FROM r WHERE event_id % 5 <> 0)
            SELECT 'u' || user_id AS file_name, event_id AS size, event_id AS mtime, event_type AS sha256 FROM idx WHERE user_id NOT IN (SELECT user_id FROM sure)
            UNION ALL SELECT 'n' || user_id, event_id, event_id, event_type FROM sure WHERE event_id % 3 <> 0""",
        "newest_k": "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 20",
        "title_search": """SELECT p_name || CASE WHEN p_name IN (SELECT p_name FROM part WHERE p_partkey % 50 = 0) THEN ' (already assigned)' ELSE '' END AS label
            FROM (SELECT DISTINCT p_name FROM part) WHERE contains(lower(p_name), lower('RED'))""",
        "review_decisions": """WITH q AS (SELECT p_partkey AS pos, 'f' || p_partkey AS stem, p_name AS suggested,
              CASE WHEN p_partkey = 3001 THEN 'stop' WHEN p_partkey % 5 = 0 THEN 'no' WHEN p_partkey % 7 = 0 THEN 'keep' WHEN p_partkey % 11 = 0 THEN NULL ELSE 'yes' END AS decision,
              CASE WHEN p_partkey % 13 = 0 THEN 'own ' || CAST(p_partkey % 3 AS VARCHAR) WHEN p_partkey % 17 = 0 THEN 'known' END AS chosen FROM part),
            e AS (SELECT min(pos) AS e FROM q WHERE decision = 'stop'),
            t AS (SELECT q.*, coalesce(pos >= e, false) AS over_, CASE WHEN NOT coalesce(pos >= e, false) THEN CASE decision WHEN 'yes' THEN coalesce(chosen, suggested) WHEN 'keep' THEN stem END END AS title FROM q, e),
            w AS (SELECT *, title IS NOT NULL AND row_number() OVER (PARTITION BY title ORDER BY pos) = 1 AS won FROM t),
            o AS (SELECT *, CASE WHEN over_ THEN 'left' WHEN decision = 'no' THEN 'refused' WHEN title IS NULL THEN 'left' WHEN NOT won THEN 'claimed' WHEN decision = 'keep' THEN 'kept' ELSE 'linked' END AS outcome FROM w)
            SELECT pos, stem, outcome, CASE WHEN outcome IN ('linked', 'kept') THEN title END AS title,
              CASE WHEN outcome IN ('linked', 'kept') THEN CASE WHEN title = suggested OR decision = 'keep' THEN 'Human-Confirmed' WHEN title = 'known' OR title IN (SELECT suggested FROM q) THEN 'Human-Selected' ELSE 'Human-Entered' END END AS matched_via FROM o""",
        "run_counters": """WITH r AS (SELECT p_name AS stem, CASE WHEN p_partkey % 2 = 0 THEN p_name WHEN p_partkey % 5 <> 0 THEN 'other' END AS t,
              CASE WHEN p_partkey % 3 = 0 THEN 'c' WHEN p_partkey % 4 = 0 THEN 'l' ELSE 'm' END AS m FROM part)
            SELECT count(*) AS files, count(t) AS matched, count(*) FILTER (t = stem) AS already_correct, count(*) FILTER (m = 'c') AS from_cache,
              count(*) FILTER (m = 'l') AS low_confidence, count(*) FILTER (t IS NULL) AS unmatched FROM r""",
        "already_correct": "SELECT p_partkey, p_name IN (SELECT p_name FROM part WHERE p_partkey % 40 = 0) AS is_correct FROM part",
        "file_order": """WITH f AS (SELECT p_partkey AS pos, p_partkey // 4 AS g, p_partkey % 4 AS k FROM part)
            SELECT pos, row_number() OVER (ORDER BY k = 1 AND EXISTS (SELECT 1 FROM f p WHERE p.g = f.g AND p.k = 0), pos) - 1 AS place FROM f""",
    }
    found["nonpdf_claims"] = f"""WITH chosen AS ({found['nonpdf_longest']}), m AS (SELECT min(p_partkey) AS pos FROM part GROUP BY p_name),
        f AS (SELECT m.pos, 'Item: ' || c.pos % 10 AS title, 'Item ' || c.pos % 10 || '.iso' AS wanted FROM m LEFT JOIN chosen c ON c.name_id = m.pos),
        g AS (SELECT *, CASE WHEN pos % 6 = 0 AND title IS NOT NULL THEN wanted ELSE 'f' || pos || '.iso' END AS old,
          row_number() OVER (PARTITION BY title ORDER BY pos) = 1 AS won FROM f),
        h AS (SELECT *, CASE WHEN title IS NULL THEN 'unmatched' WHEN NOT won THEN 'claimed' WHEN wanted = old THEN 'kept'
          WHEN wanted = 'Item 3.iso' OR wanted IN (SELECT old FROM g) THEN 'taken' ELSE 'renamed' END AS outcome FROM g)
        SELECT pos, old, CASE WHEN outcome = 'renamed' THEN wanted END AS new, outcome FROM h"""
    side = "CASE WHEN l_linenumber <> 7 THEN ({}) % 3000 END".format
    images = f"""images AS (SELECT l_orderkey AS path, l_partkey % 4 AS page, l_linenumber AS place,
        {side('l_partkey * 7 % 5 * 800 + l_suppkey')} AS width, {side('l_partkey % 3 * 1100')} AS height FROM lineitem)"""
    found["page_image_choice"] = f"""WITH {images} SELECT path, page, place, width, height FROM images WHERE width > 0 AND height > 0
        QUALIFY row_number() OVER (PARTITION BY path, page ORDER BY width * height DESC, place) = 1"""
    read = "CASE WHEN greatest(width, height) <= 2200 THEN {0} ELSE greatest(1, CAST(floor({0} * (2200::DOUBLE / greatest(width, height))) AS BIGINT)) END".format
    found["readable_images"] = f"""WITH {images} SELECT images.*, page < 2 AS is_front, page >= o_custkey % 9 - 1 AS is_back, {read('width')} AS read_width, {read('height')} AS read_height
        FROM images JOIN orders ON path = o_orderkey WHERE width >= 20 AND height >= 20 AND page <= o_custkey % 9 AND (page < 2 OR page >= o_custkey % 9 - 1)"""
    found["undo_plan"] = f"SELECT pos, new AS old, old AS new FROM ({found['suffix_numbering']}) WHERE new IS NOT NULL AND old <> new AND pos % 3 <> 0"
    return found
