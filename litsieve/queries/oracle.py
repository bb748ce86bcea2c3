"""The registered queries in plain SQL, for an independent engine on the same tables."""

from __future__ import annotations

from litsieve.functions.stopwords import default_stop_words
from litsieve.plans.sweep import FRACTIONS, FULL_TEXT_LEVELS, LEVELS, NEIGHBOURS, TUNE_LEVELS

ORACLE: dict[str, str] = {}


def _replace(text: str, *pairs: tuple[str, str]) -> str:
    for pattern, replacement in pairs:
        quoted = pattern.replace("'", "''")
        text = f"regexp_replace({text}, '{quoted}', '{replacement}', 'g')"
    return text


WHITE = (r"[ \t\n\x0B\f\r]+", " ")


def _plain(text: str) -> str:
    return _replace(
        f"lower({text})", (r"[\n\f]", " "), ("[0-9]*[.]?[0-9]+", " "), ("[[:punct:]]+", ""), WHITE
    )


def _tagged(text: str) -> str:
    return _replace(
        f"lower({text})",
        (r"\n", " "),
        ("[0-9]*[.]?[0-9]+", "anynumber"),
        ("[0-9a-z]+@[0-9a-z]+", "emailadd"),
        ("anynumber%", "percentage"),
        ("anynumberanynumber", "anynumber"),
        ("<[^<>]+>", " "),
        ("[+][/][-]", "plusminus"),
        ("[()@$#.:&<>/*+=-^]", " "),
        ("[[:punct:]]+", ""),
        WHITE,
    )


def _hash01(seed: int, id_col: str = "doc_id") -> str:
    bits = f"CAST('0x' || substr(md5('{seed}:' || {id_col}), 1, 8) AS BIGINT)"
    return f"(CAST({bits} AS DOUBLE) / CAST(4294967296 AS DOUBLE))"


def _d(x: float) -> str:
    return f"CAST('{x}' AS DOUBLE)"


def _split(id_col: str = "doc_id") -> str:
    h = _hash01(42, id_col)
    return (
        f"CASE WHEN {h} < {_d(0.6)} THEN 'train' WHEN {h} < {_d(0.6)} + {_d(0.2)} THEN 'validate' "
        "ELSE 'test' END"
    )


ORACLE["normalize_text"] = f"SELECT doc_id, {_plain('text')} AS text FROM documents"
ORACLE["normalize_text_tagged"] = f"SELECT doc_id, {_tagged('text')} AS text FROM documents"
ORACLE["normalize_pages_tagged"] = f"SELECT page_id, {_tagged('html')} AS text FROM pages"
_stop_words = ", ".join("'" + w.replace("'", "''") + "'" for w in default_stop_words())
ORACLE["remove_stopwords"] = f"""
SELECT doc_id, array_to_string(
         list_filter(string_split({_plain('text')}, ' '), lambda w: w <> '' AND w NOT IN ({_stop_words})), ' ') AS text
FROM documents"""

# ---- document-term table ----

LABELLED = "clean AS (SELECT d.doc_id, l.quality = 1 AS flag, d.text FROM documents d JOIN labels l USING (doc_id))"


def _counts(source: str = "clean", keep: str = "flag", stopped: bool = False) -> str:
    """CTEs up to ``counts``; ``stopped``: tagged texts without stop words."""
    cols = f"doc_id, {keep}" if keep else "doc_id"
    words = f"AND term NOT IN ({_stop_words})" if stopped else ""
    return f"""
tokens AS (SELECT {cols}, unnest(string_split({(_tagged if stopped else _plain)('text')}, ' ')) AS term FROM {source}),
grouped AS (SELECT {cols}, term, count(*) AS tf FROM tokens WHERE length(term) >= 3 {words} GROUP BY ALL),
counts AS (SELECT *, CAST(sum(tf) OVER (PARTITION BY doc_id) AS BIGINT) AS n_tokens FROM grouped)"""


def _vocab(level: float, source: str = "clean", seen: str = "") -> str:
    """``seen``: condition of the rows that give document frequencies."""
    return f"""
total AS (SELECT count(*) AS n FROM {source}{seen}),
freq AS (SELECT term, count(*) AS df FROM counts{seen} GROUP BY term),
vocab AS (SELECT term, df FROM freq, total
          WHERE CAST(df AS DOUBLE) > CAST(n AS DOUBLE) * (CAST(1 AS DOUBLE) - {_d(level)})),
weights AS (SELECT c.*, df, CAST(tf AS DOUBLE) / n_tokens * log2(CAST(n AS DOUBLE) / df) AS weight
            FROM counts c JOIN vocab USING (term), total)"""


ORACLE["term_counts"] = f"WITH {_counts('documents', '')} SELECT doc_id, n_tokens, term, tf FROM counts"
ORACLE["sparse_vocab"] = f"WITH {LABELLED}, {_counts()}, {_vocab(0.92)} SELECT term, df FROM vocab"
ORACLE["tfidf"] = f"""WITH {LABELLED}, {_counts()}, {_vocab(0.92)}
SELECT doc_id, term, tf, n_tokens, round(weight, 6) AS weight FROM weights"""
ORACLE["presence"] = f"""WITH {LABELLED}, {_counts()}, {_vocab(0.95)}
SELECT doc_id, flag, term FROM weights WHERE weight > 0"""
ORACLE["feature_summary"] = f"""WITH {LABELLED}, {_counts()}, {_vocab(0.95)}
SELECT (SELECT n FROM total) AS n_docs, (SELECT count(*) FROM vocab) AS n_features"""
ORACLE["class_term_frequency"] = f"""WITH {LABELLED}, {_counts()}
SELECT flag, term, CAST(sum(tf) AS BIGINT) AS freq FROM counts GROUP BY flag, term
HAVING sum(tf) >= CASE WHEN flag THEN 20 ELSE 60 END"""
ORACLE["role_term_frequency"] = f"""
WITH turns AS (SELECT conv_id || ':' || turn AS doc_id, role, text FROM conversations), {_counts('turns', 'role')}
SELECT role, term, CAST(sum(tf) AS BIGINT) AS freq FROM counts
GROUP BY role, term HAVING sum(tf) >= CASE role WHEN 'user' THEN 20 WHEN 'assistant' THEN 60 ELSE 1 END"""
ORACLE["class_counts"] = f"WITH {LABELLED} SELECT flag, count(*) AS n FROM clean GROUP BY flag"
ORACLE["class_weights"] = f"""WITH {LABELLED},
sizes AS (SELECT flag, count(*) AS n FROM clean WHERE {_split()} = 'train' GROUP BY flag)
SELECT flag, n, round(min(n) OVER () / CAST(n AS DOUBLE), 6) AS weight FROM sizes"""

# ---- sampling and splits ----

ORACLE["shuffle_key"] = "SELECT doc_id, md5('1:' || doc_id) AS shuffle_key FROM documents"
ORACLE["ratio_sample"] = f"SELECT doc_id FROM documents WHERE {_hash01(1)} < {_d(0.3)}"
ORACLE["split_train_validate_test"] = f"SELECT doc_id, {_split()} AS split FROM documents"
ORACLE["split_exact"] = """
WITH ranked AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id)) AS r,
                       count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN r <= round_even(n * 0.6, 0) THEN 'train'
                    WHEN r <= round_even(n * 0.6, 0) + round_even(n * 0.2, 0) THEN 'validate'
                    ELSE 'test' END AS split FROM ranked"""
ORACLE["holdout_split"] = f"""SELECT doc_id, CASE WHEN {_hash01(42)} < {_d(0.2)} THEN 'test' ELSE 'train' END AS split
FROM documents"""
ORACLE["holdout_split_sampled"] = f"""
SELECT doc_id, CASE WHEN {_hash01(42)} < {_d(0.2)} THEN 'test'
                    WHEN {_hash01(42)} < {_d(0.7)} THEN 'train' END AS split FROM documents"""
ORACLE["kfold_assign"] = f"SELECT doc_id, CAST(floor({_hash01(7)} * 10) AS INTEGER) AS fold FROM documents"
_fractions = ", ".join(f"({_d(f)})" for f in FRACTIONS)
ORACLE["prefix_sizes"] = f"""SELECT fraction, count(doc_id) AS n_rows
FROM (VALUES {_fractions}) v(fraction) LEFT JOIN documents ON {_hash01(1)} < fraction GROUP BY fraction"""

# ---- screening tables ----

SCREENING = """screening AS (
SELECT CAST(d.doc_id AS INTEGER) AS id, lang AS type, source AS author, CAST(2005 + n_chars % 15 AS INTEGER) AS year,
       split_part(text, chr(10), 1) AS title, text, quality = 1 AS s1_included, quality <> 1 AS s1_excluded,
       toxic = 0 AS s2_included, toxic <> 0 AS s2_excluded
FROM documents d LEFT JOIN labels l USING (doc_id)),
left_side AS (SELECT * REPLACE (lower(title) AS title) FROM screening WHERE length(title) > 0)"""
BIBLIOGRAPHY = """right_side AS (
SELECT lower(split_part(text, chr(10), 1)) AS title,
       CASE lang WHEN 'en' THEN 'article' WHEN 'fr' THEN 'review' WHEN 'de' THEN 'meeting' END AS jatype
FROM documents WHERE 2005 + n_chars % 15 <= 2014 AND source NOT IN ('src3', 'src4'))"""
MERGED = f"""{SCREENING}, {BIBLIOGRAPHY},
merged AS (SELECT coalesce(l.title, r.title) AS title, l.* EXCLUDE (title), r.jatype
           FROM left_side l FULL JOIN right_side r ON l.title = r.title)"""
ORACLE["screening_agreement"] = f"""WITH {SCREENING}
SELECT CAST(id AS BIGINT) AS doc_id, text, s1_included AS flag FROM screening WHERE s1_included = s2_included"""
ORACLE["screening_union"] = ORACLE["screening_agreement"]
ORACLE["bibliography_clean"] = f"WITH {BIBLIOGRAPHY} SELECT title, jatype FROM right_side"
# rows of the left side have an id, so equal (id, title, jatype) rows are copies of the right side
ORACLE["title_merge"] = f"""WITH {MERGED}
SELECT id, title, jatype, count(*) AS copies FROM merged GROUP BY id, title, jatype"""
_kept = """length(text) > 0 AND (jatype IN ('article', 'review') OR jatype IS NULL) AND id IS NOT NULL"""
ORACLE["papers_kept"] = f"""WITH {MERGED}
SELECT id, title, jatype, count(*) AS copies FROM merged
WHERE {_kept} AND NOT contains(title, 'erth') AND NOT contains(title, 'tion') GROUP BY id, title, jatype"""
ORACLE["type_frequency"] = f"WITH {MERGED} SELECT jatype, count(*) AS n FROM merged GROUP BY jatype"
ORACLE["merged_agreement"] = f"""WITH {MERGED}
SELECT id, s1_included AS flag, count(*) AS copies, {_tagged('text')} AS text FROM merged
WHERE {_kept} AND NOT contains(title, 'meeting') AND NOT contains(title, 'conference') AND s1_included = s2_included
GROUP BY id, s1_included, jatype, text"""
_rewritten = _replace("hlink", ("/en/", "/english/"), ("/fr/", "/french/"), ("example", "sample"))
ORACLE["link_normalize"] = f"""
WITH kept AS (SELECT page_id, url AS hlink FROM pages WHERE regexp_matches(url, '(?i).html$')),
moved AS (SELECT page_id, CASE WHEN regexp_matches(hlink, '(?i)^http://[a-z]+[.]') THEN {_rewritten} ELSE hlink END AS hlink
          FROM kept),
bare AS (SELECT page_id, {_replace('hlink', ('/es', ''), ('/de', ''))} AS hlink FROM moved),
mounted AS (SELECT page_id, CASE WHEN regexp_matches(hlink, '(?i)^https:') THEN hlink
                                 ELSE regexp_replace(hlink, '(?i)^http:', 'https:') END AS hlink FROM bare),
rooted AS (SELECT page_id, CASE WHEN regexp_matches(hlink, '(?i)^https:') THEN hlink
                                ELSE 'https://library/' || hlink END AS hlink FROM mounted)
SELECT page_id, hlink, regexp_replace(hlink, '(?i).html$', '.txt') AS txtlink FROM rooted"""

# ---- files ----

ORACLE["screening_tsv"] = f"WITH {SCREENING} SELECT * FROM left_side"
ORACLE["bibliography_tsv"] = ORACLE["bibliography_clean"]
ORACLE["manifest_tsv"] = """SELECT page_id % 3 = 0 AS flag, url AS hlink FROM pages
WHERE regexp_matches(url, '(?i).html$')"""
ORACLE["load_bodies"] = r"""SELECT d.doc_id,
  CASE WHEN l.doc_id IS NULL THEN ''
       ELSE regexp_replace(regexp_replace(text || chr(10), '\r?\n$', ''), '\r?\n', '', 'g') END AS text
FROM documents d LEFT JOIN labels l USING (doc_id)"""
FULL_TEXT = r"""papers AS (
SELECT doc_id, quality = 1 AS flag,
       CASE doc_id % 4 WHEN 0 THEN 'S:\Publications\MS Clinical Trial\Journals\' WHEN 1 THEN 'S:\' WHEN 2 THEN 'S:\Reviews\'
                       ELSE 'S:\Publications\' END
       || CASE doc_id % 3 WHEN 0 THEN 'paper ' WHEN 1 THEN '100% of %20' ELSE 'a+b ' END || doc_id
       || CASE WHEN doc_id % 7 = 4 THEN '.PDF' ELSE '.pdf' END AS hlink,
       regexp_replace(text, '\r?\n|\r', '', 'g') AS text
FROM documents JOIN labels USING (doc_id) WHERE doc_id % 7 <> 3),
clean AS (SELECT * FROM papers WHERE length(text) > 1000)"""
ORACLE["full_text_papers"] = f"WITH {FULL_TEXT} SELECT doc_id, flag, hlink, text FROM clean"
ORACLE["long_bodies"] = "SELECT doc_id, length(text) AS n FROM documents WHERE length(text) > 1000"

# ---- naive Bayes: every variant (v, level) has its own train rows and its own scored rows ----

METRICS = """
 round((tp + tn) / n, 6) AS accuracy,
 round(greatest(tp + fn, fp + tn) / n, 6) AS no_information_rate,
 round(((tp + tn) / n - expected) / nullif(1 - expected, 0), 6) AS kappa,
 round(CASE WHEN fp + fn = 0 THEN NULL WHEN fp = fn THEN 0 ELSE power(abs(fp - fn) - 1, 2) / (fp + fn) END, 6) AS mcnemar,
 round(tp / nullif(tp + fn, 0), 6) AS sensitivity,
 round(tn / nullif(tn + fp, 0), 6) AS specificity,
 round(tp / nullif(tp + fp, 0), 6) AS ppv,
 round(tn / nullif(tn + fn, 0), 6) AS npv,
 round((tp + fn) / n, 6) AS prevalence,
 round(tp / n, 6) AS detection_rate,
 round((tp + fp) / n, 6) AS detection_prevalence,
 round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced_accuracy"""


def _metrics(by: str, source: str = "predictions") -> str:
    """CTE ``metrics``: counts and rounded metrics per group."""
    return f"""
cells AS (SELECT {by}, count(*) FILTER (predicted AND flag) AS tp, count(*) FILTER (predicted AND NOT flag) AS fp,
  count(*) FILTER (NOT predicted AND flag) AS fn, count(*) FILTER (NOT predicted AND NOT flag) AS tn
  FROM {source} GROUP BY {by}),
sized AS (SELECT *, nullif(CAST(tp + fp + fn + tn AS DOUBLE), 0) AS n,
  (CAST(tp + fp AS DOUBLE) * (tp + fn) + CAST(fn + tn AS DOUBLE) * (fp + tn))
  / nullif(power(tp + fp + fn + tn, 2), 0) AS expected FROM cells),
metrics AS (SELECT {by}, tp, fp, fn, tn, {METRICS} FROM sized)"""


def _bayes(
    variants: str, in_train: str, in_score: str, scope: str = "all", clean: str = LABELLED, stopped: bool = False, key: str = "doc_id"
) -> str:
    """CTEs up to ``predictions``; ``variants`` are rows of (v, level, x)."""
    df = "(n_true_docs + n_false_docs)" if scope == "train" else "f.df"
    n = "(s.n_true + s.n_false)" if scope == "train" else "n"
    return f"""{clean}, {_counts(stopped=stopped)},
total AS (SELECT count(*) AS n FROM clean),
freq AS (SELECT term, count(*) AS df FROM counts GROUP BY term),
docs AS (SELECT doc_id, flag, {_split(key)} AS split, {_hash01(1, key)} AS h,
                CAST(floor({_hash01(7, key)} * 5) AS INTEGER) AS fold FROM clean),
variants AS (SELECT * FROM (VALUES {variants}) t(v, level, x)),
train AS (SELECT v, doc_id, flag FROM docs, variants WHERE {in_train}),
scored AS (SELECT v, level, x, doc_id, flag, split, fold FROM docs, variants WHERE {in_score}),
sizes AS (SELECT v.v, count(t.doc_id) FILTER (flag) AS n_true, count(t.doc_id) FILTER (NOT flag) AS n_false
          FROM variants v LEFT JOIN train t ON t.v = v.v GROUP BY v.v),
seen AS (SELECT t.v, c.term, count(*) FILTER (t.flag) AS n_true_docs, count(*) FILTER (NOT t.flag) AS n_false_docs
         FROM train t JOIN counts c USING (doc_id) GROUP BY t.v, c.term),
candidates AS (SELECT v.v, v.level, f.term, f.df, coalesce(n_true_docs, 0) AS n_true_docs,
                      coalesce(n_false_docs, 0) AS n_false_docs
               FROM variants v CROSS JOIN freq f LEFT JOIN seen ON seen.v = v.v AND seen.term = f.term),
shares AS (SELECT f.v, f.term,
    CAST(n_true_docs AS DOUBLE) / nullif(s.n_true, 0) AS pt, CAST(s.n_true - n_true_docs AS DOUBLE) / nullif(s.n_true, 0) AS qt,
    CAST(n_false_docs AS DOUBLE) / nullif(s.n_false, 0) AS pf, CAST(s.n_false - n_false_docs AS DOUBLE) / nullif(s.n_false, 0) AS qf
  FROM candidates f JOIN sizes s USING (v), total
  WHERE CAST({df} AS DOUBLE) > CAST({n} AS DOUBLE) * (CAST(1 AS DOUBLE) - f.level) AND {df} < {n}),
logs AS (SELECT v, term, ln(CASE WHEN pt <= 0 THEN 0.001 ELSE pt END) AS lpt, ln(CASE WHEN qt <= 0 THEN 0.001 ELSE qt END) AS lqt,
    ln(CASE WHEN pf <= 0 THEN 0.001 ELSE pf END) AS lpf, ln(CASE WHEN qf <= 0 THEN 0.001 ELSE qf END) AS lqf FROM shares),
base AS (SELECT v, sum(lqt) AS bt, sum(lqf) AS bf FROM logs GROUP BY v),
gains AS (SELECT l.v, c.doc_id, sum(lpt - lqt) AS gt, sum(lpf - lqf) AS gf
          FROM counts c JOIN logs l USING (term) GROUP BY l.v, c.doc_id),
scores AS (SELECT s.*, n_true, n_false,
    CASE WHEN n_true > 0 THEN ln(n_true / CAST(n_true + n_false AS DOUBLE)) + coalesce(bt, 0) + coalesce(gt, 0) END AS score_true,
    CASE WHEN n_false > 0 THEN ln(n_false / CAST(n_true + n_false AS DOUBLE)) + coalesce(bf, 0) + coalesce(gf, 0) END AS score_false
  FROM scored s JOIN sizes USING (v) LEFT JOIN base USING (v)
  LEFT JOIN gains g ON g.v = s.v AND g.doc_id = s.doc_id),
predictions AS (SELECT *, CASE WHEN n_true = 0 AND n_false = 0 THEN NULL WHEN n_true = 0 THEN false
    WHEN n_false = 0 THEN true ELSE round(score_true - score_false, 9) >= 0 END AS predicted FROM scores)"""


def _rows(points) -> str:
    return ", ".join(f"({v}, {_d(level)}, {_d(x)})" for v, level, x in points)


_single = _bayes(_rows([(0, 0.95, 1)]), "split = 'train'", "true")
ORACLE["nb_predict"] = f"""WITH {_single}
SELECT doc_id, flag, split, round(score_true, 6) AS score_true, round(score_false, 6) AS score_false, predicted
FROM predictions"""
ORACLE["nb_metrics"] = f"WITH {_single}, {_metrics('split')} SELECT * FROM metrics"
_train_scope = _bayes(_rows([(0, 0.95, 1)]), "split = 'train'", "true", "train")
ORACLE["nb_train_scope"] = f"WITH {_train_scope}, {_metrics('split')} SELECT * FROM metrics"
_full_text = _bayes(_rows((i, s, s) for i, s in enumerate(FULL_TEXT_LEVELS)), "split = 'train'", "true", clean=FULL_TEXT)
ORACLE["full_text_nb_curve"] = f"""WITH {_full_text}, {_metrics('x, split')}
SELECT x AS xvar, * EXCLUDE (x) FROM metrics"""
_levels = _bayes(_rows((i, s, s) for i, s in enumerate(LEVELS)), "split = 'train'", "true")
_curve = f"WITH {_levels}, {_metrics('x, split')}"
ORACLE["nb_feature_curve"] = f"{_curve} SELECT x AS xvar, * EXCLUDE (x) FROM metrics"
_prefixes = _bayes(
    _rows((i, 0.95, f) for i, f in enumerate(FRACTIONS)), "split = 'train' AND h < x", "h < x"
)
ORACLE["nb_learning_curve"] = f"""WITH {_prefixes}, {_metrics('x, split')},
prefixes AS (SELECT x, CAST(count(*) AS DOUBLE) AS xvar FROM scored GROUP BY x)
SELECT x AS fraction, xvar, m.* EXCLUDE (x) FROM metrics m JOIN prefixes USING (x)"""
_five = (
    _rows((i * 5 + f, s, f) for i, s in enumerate(TUNE_LEVELS) for f in range(5)),
    "fold <> CAST(x AS INTEGER)",
    "fold = CAST(x AS INTEGER)",
)
_folds = _bayes(*_five)
ORACLE["nb_kfold_tuning"] = f"""WITH {_folds}, {_metrics('level, x')},
exact AS (SELECT level, tp / nullif(tp + fn, 0) AS sens, tn / nullif(tn + fp, 0) AS spec FROM cells)
SELECT level AS sparselevel, round(avg(sens), 6) AS sensitivity, round(avg(spec), 6) AS specificity,
       round(avg((sens + spec) / 2), 6) AS balanced_accuracy FROM exact GROUP BY level"""
TRAIN_ONLY = f"{LABELLED.removesuffix(')')} WHERE {_split()} = 'train')"
_tuned = f"""WITH {_bayes(*_five, clean=TRAIN_ONLY)}, {_metrics('level, x')},
exact AS (SELECT level, tp / nullif(tp + fn, 0) AS sens, tn / nullif(tn + fp, 0) AS spec FROM cells),
means AS (SELECT level, avg(sens) AS sens, round(avg((sens + spec) / 2), 9) AS middle FROM exact GROUP BY level)
SELECT level AS best FROM means WHERE sens > 0.8 ORDER BY middle DESC, level LIMIT 1"""
_tuned_levels = _bayes(_rows((i, s, s) for i, s in enumerate(TUNE_LEVELS)), "split = 'train'", "true")
ORACLE["tuned_nb_holdout"] = f"""WITH {_tuned_levels}, {_metrics('x, split')}
SELECT x AS xvar, * EXCLUDE (x, best) FROM metrics JOIN ({_tuned}) ON x = best WHERE split = 'test'"""
ORACLE["term_counts_stopped"] = f"""WITH {_counts('documents', '', stopped=True)}
SELECT doc_id, n_tokens, term, tf FROM counts"""
_stopped = _bayes(_rows([(0, 0.95, 1)]), "split = 'train'", "true", stopped=True)
ORACLE["nb_metrics_stopped"] = f"WITH {_stopped}, {_metrics('split')} SELECT * FROM metrics"
ORACLE["best_params"] = f"""{_curve}
SELECT split, x AS xvar, sensitivity, specificity, balanced_accuracy FROM metrics
WHERE sensitivity > 0.8 AND split = 'validate'
QUALIFY row_number() OVER (PARTITION BY split ORDER BY balanced_accuracy DESC, x) = 1"""
ORACLE["best_balanced"] = f"""{_curve}
SELECT split, x AS xvar, sensitivity, specificity, balanced_accuracy FROM metrics
WHERE sensitivity > -1 AND split = 'validate'
QUALIFY row_number() OVER (PARTITION BY split ORDER BY balanced_accuracy DESC, x) = 1"""
ORACLE["metrics_long"] = f"""{_curve}
SELECT x AS xvar, split || '_tpr' AS variable, sensitivity AS value FROM metrics UNION ALL
SELECT x, split || '_BAccuracy', balanced_accuracy FROM metrics UNION ALL
SELECT x, split || '_tnr', specificity FROM metrics"""
_none = "CAST(NULL AS DOUBLE) AS sparselevel, CAST(NULL AS DOUBLE) AS cost, CAST(NULL AS DOUBLE) AS gamma, CAST(NULL AS INTEGER) AS k"
ORACLE["result_table"] = f"""SELECT 'feature_curve' AS curve, 'NB' AS model, {_none}, xvar AS point, xvar, variable, value
FROM ({ORACLE['metrics_long']}) UNION ALL
SELECT 'learning_curve', 'NB', {_none.replace('CAST(NULL AS DOUBLE) AS sparselevel', _d(0.95))}, fraction, xvar, split || suffix,
       CASE suffix WHEN '_tpr' THEN sensitivity WHEN '_tnr' THEN specificity ELSE balanced_accuracy END
FROM ({ORACLE['nb_learning_curve']}), (VALUES ('_tpr'), ('_BAccuracy'), ('_tnr')) v(suffix)"""
ORACLE["series_view"] = f"SELECT * FROM ({ORACLE['metrics_long']}) WHERE NOT contains(variable, 'test')"
ORACLE["write_series"] = ORACLE["metrics_long"]

# every merged row is a document of its own; rows of one paper share its split
SCREENED = f"""{MERGED},
clean AS (SELECT row_number() OVER () AS doc_id, id, s1_included AS flag, text FROM merged
          WHERE {_kept} AND NOT contains(title, 'meeting') AND NOT contains(title, 'conference') AND s1_included = s2_included)"""
_screened = _bayes(_rows([(0, 0.95, 1)]), "split = 'train'", "true", clean=SCREENED, stopped=True, key="id")
ORACLE["screened_nb_metrics"] = f"WITH {_screened}, {_metrics('split')} SELECT * FROM metrics"

# ---- nearest neighbours ----


def _neighbours(distances: str, ks) -> str:
    values = ", ".join(f"({k})" for k in ks)
    return f"""{distances},
ranked AS (SELECT q, flag, rank() OVER (PARTITION BY q ORDER BY d2) AS r FROM distances),
ks AS (SELECT * FROM (VALUES {values}) t(k)),
votes AS (SELECT q AS doc_id, k, count(*) FILTER (flag) AS votes_true, count(*) FILTER (NOT flag) AS votes_false
          FROM ranked, ks WHERE r <= k GROUP BY q, k),
predictions AS (SELECT d.doc_id, d.flag, d.split, k, votes_true, votes_false,
    votes_true / CAST(votes_true + votes_false AS DOUBLE) AS probability, votes_true > votes_false AS predicted
  FROM docs d JOIN votes USING (doc_id))"""


def _text_neighbours(
    level: float, upto: float = 1, clean: str = LABELLED, stopped: bool = False, key: str = "doc_id", scope: str = "all"
) -> str:
    """CTEs up to ``distances``: terms from all rows (or train rows), neighbours among the rows of a prefix."""
    seen = f" WHERE {_split(key)} = 'train'" if scope == "train" else ""
    return f"""{clean}, {_counts(stopped=stopped)}, {_vocab(level, seen=seen)},
docs AS (SELECT doc_id, flag, {_split(key)} AS split FROM clean WHERE {_hash01(1, key)} < {_d(upto)}),
norms AS (SELECT doc_id, sum(weight * weight) AS nn FROM weights GROUP BY doc_id),
dots AS (SELECT a.doc_id AS q, b.doc_id AS t, sum(a.weight * b.weight) AS dot
         FROM weights a JOIN weights b USING (term) GROUP BY a.doc_id, b.doc_id),
distances AS (SELECT a.doc_id AS q, b.flag,
    round(greatest(coalesce(x.nn, 0) + coalesce(y.nn, 0) - 2 * coalesce(dot, 0), 0), 9) AS d2
  FROM docs a CROSS JOIN docs b LEFT JOIN norms x ON x.doc_id = a.doc_id LEFT JOIN norms y ON y.doc_id = b.doc_id
  LEFT JOIN dots ON dots.q = a.doc_id AND dots.t = b.doc_id WHERE b.split = 'train')"""


_text_distances = _text_neighbours(0.95)
_vote_columns = "doc_id, flag, split, k, votes_true, votes_false, round(probability, 6) AS probability, predicted"
ORACLE["knn_predict"] = f"WITH {_neighbours(_text_distances, [3])} SELECT {_vote_columns} FROM predictions"
ORACLE["knn_small_blocks"] = ORACLE["knn_predict"]
_train_terms = _text_neighbours(0.95, scope="train")
ORACLE["knn_train_scope"] = f"WITH {_neighbours(_train_terms, [3])} SELECT {_vote_columns} FROM predictions"
_screened_distances = _text_neighbours(0.95, clean=SCREENED, stopped=True, key="id")
ORACLE["screened_knn_metrics"] = f"WITH {_neighbours(_screened_distances, [3])}, {_metrics('split')} SELECT * FROM metrics"
ORACLE["knn_k_curve"] = f"""WITH {_neighbours(_text_distances, NEIGHBOURS)}, {_metrics('k, split')}
SELECT CAST(k AS DOUBLE) AS xvar, * EXCLUDE (k) FROM metrics"""


def _nearest(xvar: str, level: float, upto: float = 1) -> str:
    """Metrics of one point of a curve with one neighbour."""
    found = f"{_neighbours(_text_neighbours(level, upto), [1])}, {_metrics('k, split')}"
    return f"SELECT * FROM (WITH {found} SELECT {xvar} AS xvar, * EXCLUDE (k) FROM metrics)"


ORACLE["knn_feature_curve"] = " UNION ALL ".join(_nearest(_d(s), s) for s in (0.95, 0.9))
ORACLE["knn_learning_curve"] = " UNION ALL ".join(
    _nearest("(SELECT CAST(count(*) AS DOUBLE) FROM docs)", 0.92, f) for f in (0.5, 1.0)
)
# every point, in one text each: an empty prefix gives no rows
ORACLE["knn_feature_curve_full"] = " UNION ALL ".join(_nearest(_d(s), s) for s in LEVELS)
ORACLE["knn_learning_curve_full"] = " UNION ALL ".join(
    _nearest("(SELECT CAST(count(*) AS DOUBLE) FROM docs)", 0.92, f) for f in FRACTIONS
)
_dense_distances = f"""
docs AS (SELECT vec_id AS doc_id, label < 5 AS flag, {_split('vec_id')} AS split,
                CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
distances AS (SELECT a.doc_id AS q, b.flag, round(greatest(list_inner_product(a.e, a.e)
    + list_inner_product(b.e, b.e) - 2 * list_inner_product(a.e, b.e), 0), 9) AS d2
  FROM docs a, docs b WHERE b.split = 'train')"""
ORACLE["knn_embeddings"] = f"WITH {_neighbours(_dense_distances, NEIGHBOURS)} SELECT {_vote_columns} FROM predictions"
