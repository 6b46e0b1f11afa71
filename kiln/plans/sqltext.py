"""SQL text fragments for the DuckDB oracle of each registered query.

These are the independent, plain-SQL statements of what each Spark plan must
return (RE2 regex syntax, DuckDB lambdas). They are only used by the
correctness check, never by the Spark jobs.
"""

from __future__ import annotations

WS = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def first_tag(x: str, open_t: str, close_t: str) -> str:
    return f"regexp_extract({x}, '(?s){open_t}(.*?){close_t}', 1)"


def answer(x: str) -> str:
    return strip(first_tag(x, "<answer>", "</answer>"))


def count_occ(x: str, t: str) -> str:
    return f"((length({x}) - length(replace({x}, '{t}', ''))) // length('{t}'))"


def accuracy(c: str, sol: str) -> str:
    g = answer(sol)
    return (
        f"CASE WHEN length({g}) = 0 THEN CAST(NULL AS DOUBLE) "
        f"WHEN {answer(c)} = {g} THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END"
    )


FORMAT_RE = r"(?s)^<think>.*?</think>\n?<answer>.*?</answer>"
FORMAT_ALL_RE = r"(?s)^<think>.*?</think>\n?<answer>.*?</answer>\n?<evaluation>.*?</evaluation>\n?<reward>.*?</reward>"


def fmt(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '{FORMAT_RE}') THEN 1 ELSE 0 END"


def fmt_all(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '{FORMAT_ALL_RE}') THEN 1 ELSE 0 END"


def count_formats(c: str) -> str:
    return (
        f"(CASE WHEN {count_occ(c, '<think>')} = 1 AND {count_occ(c, '</think>')} = 1 THEN 0.25 ELSE 0.0 END"
        f" + CASE WHEN {count_occ(c, '<answer>')} = 1 AND {count_occ(c, '</answer>')} = 1 THEN 0.25 ELSE 0.0 END)::DOUBLE"
    )


def tag_count(c: str) -> str:
    parts = [f"CASE WHEN {count_occ(c, t)} = 1 THEN 0.25 ELSE 0.0 END" for t in ("<think>", "</think>", "<answer>", "</answer>")]
    return "(" + " + ".join(parts) + ")::DOUBLE"


def words(x: str) -> str:
    return rf"list_filter(string_split_regex(lower({x}), '\s+'), lambda w: w <> '')"


ROLLOUTS = r"""
_t AS (
  SELECT doc_id, cast(floor(doc_id / 4) AS bigint) AS prompt_id, doc_id % 4 AS gen_idx, text,
         cast(cast(floor(doc_id / 4) AS bigint) % 7 AS string) AS gold,
         CASE WHEN doc_id % 3 = 0 THEN cast(cast(floor(doc_id / 4) AS bigint) % 7 AS string)
              ELSE cast(doc_id % 7 AS string) END AS pred
  FROM documents),
rollouts AS (
SELECT doc_id, prompt_id, gen_idx, gold,
       concat('<answer>', gold, '</answer>') AS solution,
       CASE doc_id % 5
         WHEN 0 THEN concat('<think>', text, '</think>', chr(10), '<answer>', pred, '</answer>')
         WHEN 1 THEN concat('<think>', text, '</think>', chr(10), '<answer>', pred, '</answer>', chr(10),
                            '<evaluation>ok</evaluation>', chr(10), '<reward>[', cast(doc_id % 2 AS string), ',1]</reward>')
         WHEN 2 THEN concat('<think>', text, '</think>', chr(10), '<answer>', pred)
         WHEN 3 THEN text
         ELSE concat('<think>', text, '</think><answer> ', pred, ' </answer><answer>x</answer>') END AS completion
FROM _t)"""

BRANCH_ROLLOUTS = r"""
_b AS (SELECT doc_id, doc_id // 4 AS prompt_id, doc_id % 4 AS gen_idx, text, doc_id // 4 % 7 AS g, doc_id // 4 % 6 AS k FROM documents),
rollouts AS (
SELECT doc_id, prompt_id, gen_idx, CASE WHEN k = 4 THEN '<answer> </answer>' ELSE concat('<answer>', g, '</answer>') END AS solution,
  CASE k WHEN 0 THEN '<answer>9</answer>'
    WHEN 1 THEN concat('<think>', chr(10), text, chr(10), '</think>', chr(10), '<answer>', chr(10), g, chr(10), '</answer>')
    WHEN 2 THEN concat(CASE WHEN gen_idx > 0 THEN concat('1. Start', chr(10), '- ', text) ELSE text END,
                       CASE WHEN gen_idx > 1 THEN chr(10) || 'First, look' ELSE '' END,
                       CASE WHEN gen_idx > 2 THEN chr(10) || 'Step 2: go on. Finally, stop' ELSE '' END)
    WHEN 3 THEN concat(text, ' so ', chr(92), 'boxed{', chr(92), 'frac{', (g + gen_idx % 2) * 2, '}{2}}')
    WHEN 4 THEN concat('<answer>', g, '</answer>', chr(10), text)
    ELSE concat('<think>', chr(10), text, chr(10), '</think>', chr(10), CASE WHEN gen_idx > 1 THEN '<answer>' || chr(10) ELSE '' END)
  END AS completion
FROM _b)"""

QA_HASH = r"""
qa_hash AS (
SELECT doc_id AS index, concat('Q', cast(doc_id AS string), ' ', text) AS question,
       concat(text, ' #### ', cast(doc_id % 11 AS string)) AS answer
FROM documents)"""

TEST_RESULTS = r"""
test_results AS (
SELECT l_orderkey AS submission_id, cast(l_linenumber % 2 AS int) AS subtask, l_linenumber AS batch_no,
       concat(cast(l_linenumber AS string), '_', cast(l_partkey AS string), '_', cast(l_suppkey AS string)) AS test_name,
       cast(CASE WHEN l_quantity < 5 THEN 0.0 WHEN l_quantity < 10 THEN 0.5 ELSE 1.0 END AS double) AS score,
       CASE WHEN l_quantity < 2 THEN 'Compilation error' WHEN l_quantity < 3 THEN 'Time limit exceeded'
            WHEN l_quantity < 5 THEN 'Output isn''t correct' ELSE '' END AS feedback
FROM lineitem)"""

STEP_METRICS = r"""
step_metrics AS (
SELECT cast(floor(event_id / 50) AS bigint) AS step, event_type AS metric,
       CASE WHEN event_id % 10 = 0 THEN 'eval' ELSE 'train' END AS mode, value
FROM events)"""


def ngrams_of(table_alias_sql: str, key: str, text: str, n: int) -> str:
    """SELECT key, g for every word n-gram of text (one row per position)."""
    return (
        f"SELECT {key}, array_to_string(w[i + 1:i + {n}], ' ') AS g FROM "
        f"(SELECT {key}, w, unnest(range(0, len(w) - {n - 1})) AS i FROM "
        f"(SELECT {key}, {words(text)} AS w FROM {table_alias_sql}))"
    )
