"""The queries with an exact SQL counterpart, in DuckDB's dialect over the same tables."""

from __future__ import annotations

from .tables import DIM, K, LEXICON_SHARE, STOPWORDS

SWEEP = ", ".join(str(k) for k in range(100, 700, 50))

# Common table expressions by name, each with the ones it needs.
PARTS = {
    "corpus": """SELECT doc_id, list_filter(regexp_extract_all(lower(text), '\\p{L}+'), lambda t: length(t) > 1) AS tokens
        FROM documents""",
    "docs": """SELECT c.doc_id, CASE WHEN l.quality = 1 THEN 'pos' ELSE 'neg' END AS label, c.tokens
        FROM corpus c JOIN labels l USING (doc_id){only}""",
    "toks": "SELECT doc_id, generate_subscripts(tokens, 1) - 1 AS pos, unnest(tokens) AS token FROM corpus",
    "ltoks": "SELECT doc_id, label, generate_subscripts(tokens, 1) - 1 AS pos, unnest(tokens) AS token FROM docs",
    "freq": "SELECT token, count(*) AS n FROM toks GROUP BY token",
    "stops": f"SELECT token FROM freq ORDER BY n DESC, token LIMIT {STOPWORDS}",
    "words": """SELECT token, count(*) FILTER (label = 'pos') AS n_pos, count(*) FILTER (label = 'neg') AS n_neg,
        count(*) AS n FROM ltoks GROUP BY token""",
    "totals": "SELECT sum(n_pos)::DOUBLE AS p, sum(n)::DOUBLE AS t FROM words",
    "word_scores": "SELECT token, n_pos, n_neg, n, round(2.0 * {chi:n_pos,n,p,t}, 6) AS score FROM words, totals",
    "top": f"""SELECT token AS feature, score, row_number() OVER (ORDER BY score DESC NULLS LAST, token) AS rank
        FROM word_scores QUALIFY rank <= {K}""",
    "pairs": """SELECT label, w1, w2, count(*) AS n FROM (SELECT label, token AS w1,
        lead(token) OVER (PARTITION BY label ORDER BY doc_id, pos) AS w2 FROM ltoks) WHERE w2 IS NOT NULL GROUP BY ALL""",
    "class_words": "SELECT label, token, count(*) AS n FROM ltoks GROUP BY ALL",
    "class_sizes": "SELECT label, count(*)::DOUBLE AS n_all FROM ltoks GROUP BY label",
    "pair_scores": """SELECT label, w1, w2, p.n, a.n AS n1, b.n AS n2, round({chi:p.n,a.n,b.n,n_all}, 6) AS score
        FROM pairs p JOIN class_words a USING (label) JOIN class_words b USING (label) JOIN class_sizes USING (label)
        WHERE a.token = w1 AND b.token = w2""",
    "top_pairs": """SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC NULLS LAST, w1, w2) AS rank
        FROM pair_scores QUALIFY rank <= 5000""",
    "mixed": """SELECT token AS w1, NULL AS w2, n_pos, n_neg, n FROM words UNION ALL
        SELECT w1, w2, count(*) FILTER (label = 'pos'), count(*) FILTER (label = 'neg'), count(*) FROM top_pairs GROUP BY w1, w2""",
    "mixed_neg": """SELECT token AS w1, NULL AS w2, n_pos, n_neg, n FROM words UNION ALL
        SELECT w1, w2, 1, 1, 2 FROM top_pairs WHERE label = 'neg'""",
    "mixed_scores": """SELECT w1, w2, concat_ws(' ', w1, w2) AS feature, n_pos, n_neg, n,
        round(2.0 * {chi:n_pos,n,p,t}, 6) AS score
        FROM {mixed}, (SELECT sum(n_pos)::DOUBLE AS p, sum(n)::DOUBLE AS t FROM {mixed})""",
    "selected": f"""SELECT w1, w2, feature, row_number() OVER (ORDER BY score DESC NULLS LAST,
        CASE WHEN w2 IS NULL THEN [w1] ELSE [w1, w2] END) AS rank FROM mixed_scores QUALIFY rank <= {K}""",
    "bags": "SELECT DISTINCT doc_id, label, token AS feature FROM ltoks",
    "fcounts": """SELECT feature, count(*) FILTER (label = 'pos') AS n_pos, count(*) FILTER (label = 'neg') AS n_neg
        FROM bags SEMI JOIN top USING (feature) GROUP BY feature""",
    "all_counts": """SELECT feature, count(*) FILTER (label = 'pos') AS n_pos, count(*) FILTER (label = 'neg') AS n_neg
        FROM bags GROUP BY feature""",
    "sizes": """SELECT count(*) FILTER (label = 'pos')::DOUBLE AS dp, count(*) FILTER (label = 'neg')::DOUBLE AS dn FROM docs""",
    "mnb": """SELECT feature, ln((n_pos + 1.0) / (sum(n_pos) OVER () + count(*) OVER ())) AS w_pos,
        ln((n_neg + 1.0) / (sum(n_neg) OVER () + count(*) OVER ())) AS w_neg FROM {counts}""",
    "mnb_bias": "SELECT ln(dp / (dp + dn)) AS b_pos, ln(dn / (dp + dn)) AS b_neg FROM sizes",
    "bnb": """SELECT feature, ln(p / (1.0 - p)) AS w_pos, ln(q / (1.0 - q)) AS w_neg, ln(1.0 - p) AS a_pos, ln(1.0 - q) AS a_neg
        FROM (SELECT feature, (n_pos + 1.0::DOUBLE) / (dp + 2.0) AS p, (n_neg + 1.0::DOUBLE) / (dn + 2.0) AS q FROM fcounts, sizes)""",
    "bnb_bias": """SELECT ln(dp / (dp + dn)) + (SELECT sum(a_pos) FROM bnb) AS b_pos,
        ln(dn / (dp + dn)) + (SELECT sum(a_neg) FROM bnb) AS b_neg FROM sizes""",
    "present": "SELECT DISTINCT doc_id, token AS feature FROM toks",
    "scored": """SELECT d.doc_id, d.label, coalesce(sum(w_pos), 0.0) + any_value(b_pos) > coalesce(sum(w_neg), 0.0) + any_value(b_neg) AS said
        FROM docs d LEFT JOIN bags b ON b.doc_id = d.doc_id LEFT JOIN mnb USING (feature), mnb_bias GROUP BY d.doc_id, d.label""",
    "confusion": """SELECT count(*) FILTER (label = 'pos' AND said) AS tp, count(*) FILTER (label = 'neg' AND said) AS fp,
        count(*) FILTER (label = 'neg' AND NOT said) AS tn, count(*) FILTER (label = 'pos' AND NOT said) AS fn FROM scored""",
    "ctoks": """SELECT DISTINCT conv_id, turn, token AS feature FROM (SELECT conv_id, turn,
        unnest(regexp_extract_all(lower(text), '{pattern}')) AS token FROM conversations) WHERE length(token) > 1""",
    "wv": """SELECT token AS word, embedding::DOUBLE[] AS vec FROM (SELECT token,
        ('0x' || substr(md5(token), 1, 8))::BIGINT % (SELECT count(*) FROM embeddings) AS vec_id FROM freq
        QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, token) = 1) JOIN embeddings USING (vec_id)""",
    "series": f"""SELECT k, count(*) FILTER (label = 'pos' AND said) AS tp, count(*) FILTER (label = 'neg' AND said) AS fp,
        count(*) FILTER (label = 'neg' AND NOT said) AS tn, count(*) FILTER (label = 'pos' AND NOT said) AS fn, model FROM says GROUP BY k, model""",
}

NEEDS = {
    "docs": ["corpus"], "toks": ["corpus"], "ltoks": ["docs"], "freq": ["toks"], "stops": ["freq"], "words": ["ltoks"],
    "totals": ["words"], "word_scores": ["words", "totals"], "top": ["word_scores"], "pairs": ["ltoks"],
    "class_words": ["ltoks"], "class_sizes": ["ltoks"], "pair_scores": ["pairs", "class_words", "class_sizes"],
    "top_pairs": ["pair_scores"], "mixed": ["words", "top_pairs"], "mixed_neg": ["words", "top_pairs"],
    "mixed_scores": ["mixed"], "selected": ["mixed_scores"], "bags": ["ltoks"], "fcounts": ["bags", "top"],
    "all_counts": ["bags"], "sizes": ["docs"], "mnb": ["fcounts"], "mnb_bias": ["sizes"], "bnb": ["fcounts", "sizes"],
    "bnb_bias": ["bnb", "sizes"], "present": ["toks"], "scored": ["docs", "bags", "mnb", "mnb_bias"], "confusion": ["scored"],
    "wv": ["freq"],
}


def _chi(spec: str) -> str:
    ii, ix, xi, xx = (f"({v})::DOUBLE" for v in spec.split(","))
    a, b, c = ii, f"({ix} - {ii})", f"({xi} - {ii})"
    d = f"({xx} - {a} - {b} - {c})"
    diff = f"({a} * {d} - {b} * {c})"
    return f"({xx} * ({diff} * {diff} / nullif(({a} + {b}) * ({a} + {c}) * ({b} + {d}) * ({c} + {d}), 0.0)))"


def _fill(body: str, options: dict[str, str]) -> str:
    while "{chi:" in body:
        start = body.index("{chi:")
        end = body.index("}", start)
        body = body[:start] + _chi(body[start + 5 : end]) + body[end + 1 :]
    for name, value in options.items():
        body = body.replace("{" + name + "}", value)
    return body


def sql(select: str, *parts: str, extra: dict[str, str] | None = None, **options: str) -> str:
    """``WITH`` the named parts and what they need, then the select."""
    options = {"mixed": "mixed", "counts": "fcounts", "pattern": "\\p{L}+", "only": ""} | options
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(options.get(need, need) if need in ("mixed",) else need)
        if name not in order:
            order.append(name)

    for p in parts:
        add(p)
    ctes = [f"{p} AS ({_fill(PARTS[p], options)})" for p in order]
    ctes += [f"{name} AS ({_fill(body, options)})" for name, body in (extra or {}).items()]
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + _fill(select, options)


RAW = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
FLAG = "CASE WHEN regexp_matches(token, '^[0-9]+$') THEN 'm' WHEN regexp_matches(token, '^[A-Za-z0-9]+$') THEN 'eng' ELSE 'x' END"
CLASSES = "(SELECT doc_id, CASE WHEN quality = 1 THEN 'pos' ELSE 'neg' END AS label FROM labels)"
SCORES = """SELECT {keys}, round(coalesce(sum(w_pos), 0.0) + any_value(b_pos), 6) AS s_pos,
    round(coalesce(sum(w_neg), 0.0) + any_value(b_neg), 6) AS s_neg,
    (coalesce(sum(w_pos), 0.0) + any_value(b_pos) > coalesce(sum(w_neg), 0.0) + any_value(b_neg))::INT::DOUBLE AS prediction"""
BY_DOC = SCORES.replace("{keys}", "d.doc_id")
BY_TURN = SCORES.replace("{keys}", "c.conv_id, c.turn")
FROM_DOCS = " FROM documents d LEFT JOIN present p ON p.doc_id = d.doc_id LEFT JOIN {m} USING (feature), {b} GROUP BY d.doc_id"
FROM_TURNS = """ FROM conversations c LEFT JOIN ({t}) p ON p.conv_id = c.conv_id AND p.turn = c.turn
    LEFT JOIN mnb USING (feature), mnb_bias GROUP BY c.conv_id, c.turn"""
DIV = "({0})::DOUBLE / nullif(({1})::DOUBLE, 0.0)"
AUC = f"({DIV.format('tp', 'tp + fn')} + 1.0 - {DIV.format('fp', 'fp + tn')}) / 2.0"
METRICS = f"""k, tp, fp, tn, fn, tp + fp + tn + fn AS n"""
DOC_PAIRS = {
    "dp": """SELECT doc_id, w1, w2, count(*) AS n FROM (SELECT doc_id, token AS w1,
        lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS w2 FROM toks) WHERE w2 IS NOT NULL GROUP BY ALL""",
    "dw": "SELECT doc_id, token, count(*) AS n FROM toks GROUP BY ALL",
    "ds": "SELECT doc_id, count(*) AS size FROM toks GROUP BY doc_id",
    "best": """SELECT doc_id, w1 || ' ' || w2 AS feature, p.n, round({chi:p.n,a.n,b.n,size}, 6) AS score,
        row_number() OVER (PARTITION BY doc_id ORDER BY score DESC NULLS LAST, w1, w2) AS rank
        FROM dp p JOIN dw a USING (doc_id) JOIN dw b USING (doc_id) JOIN ds USING (doc_id)
        WHERE a.token = w1 AND b.token = w2 QUALIFY rank <= 1000""",
}
SAYS_MNB = f"""SELECT 'MultinomialNB' AS model, k, d.label, coalesce(sum(w) FILTER (rank <= k), 0.0)
      + count(rank) FILTER (rank <= k) * any_value(shift) + any_value(ln(dp / dn)) > 0 AS said
    FROM (SELECT doc_id, label FROM docs) d LEFT JOIN bags b ON b.doc_id = d.doc_id LEFT JOIN ranked USING (feature), per_k, sizes
    GROUP BY k, d.doc_id, d.label"""
SWEEP_MNB = {
    "ranked": "SELECT feature, rank, n_pos, n_neg, ln(n_pos + 1.0) - ln(n_neg + 1.0) AS w FROM fcounts JOIN top USING (feature)",
    "per_k": f"""SELECT k, ln((sum(n_neg) + count(*))::DOUBLE) - ln((sum(n_pos) + count(*))::DOUBLE) AS shift
        FROM ranked, (SELECT unnest([{SWEEP}]) AS k) WHERE rank <= k GROUP BY k""",
}
SWEEP_BNB = {
    "ranked_b": "SELECT feature, rank, w_pos - w_neg AS w, a_pos - a_neg AS a FROM bnb JOIN top USING (feature)",
    "per_k_b": f"SELECT k, sum(a) AS shift FROM ranked_b, (SELECT unnest([{SWEEP}]) AS k) WHERE rank <= k GROUP BY k",
}
SAYS_BNB = f"""SELECT 'BernoulliNB' AS model, k, d.label, coalesce(sum(w) FILTER (rank <= k), 0.0)
      + any_value(shift) + any_value(ln(dp / dn)) > 0 AS said
    FROM (SELECT doc_id, label FROM docs) d LEFT JOIN bags b ON b.doc_id = d.doc_id LEFT JOIN ranked_b USING (feature), per_k_b, sizes
    GROUP BY k, d.doc_id, d.label"""

NEAR = """SELECT q.word AS query, v.word, round(list_cosine_similarity(q.vec, v.vec), 6) AS cosine,
    row_number() OVER (PARTITION BY q.word ORDER BY cosine DESC, v.word) AS rank
    FROM {q} q JOIN wv v ON v.word <> q.word QUALIFY rank <= 10"""

HELD_OUT = "(FROM embeddings WHERE ('0x' || substr(md5(vec_id || '-7'), 1, 8))::BIGINT >= 3435973836)"
NODES = "SELECT '{0}' AS model, count(*) AS n, count(*) AS same FROM " + HELD_OUT

ORACLE = {
    "dense_tree_nodes": NODES.format("DecisionTree"),
    "dense_forest_nodes": NODES.format("RandomForest"),
    "dense_gbt_nodes": NODES.format("GBT"),
    "gbt_stages_nodes": f"SELECT k::INT AS k, count(*) AS n, count(*) AS same FROM {HELD_OUT}, (SELECT unnest(range(1, 30, 5)) AS k) GROUP BY k",
    "sentence_text_gbt": "SELECT 'GBT' AS model, count(*) AS n, count(*) AS same FROM conversations",
    "text_vectors_roundtrip": sql("SELECT word, generate_subscripts(vec, 1) - 1 AS dim, unnest(vec) AS value FROM wv", "wv"),
    "corpus_tokens": sql("SELECT doc_id, label, pos, token FROM ltoks", "ltoks"),
    "json_corpus_roundtrip": sql("SELECT doc_id, label, len(tokens) AS n_tokens, array_to_string(tokens, ' ') AS words FROM docs", "docs"),
    "json_array_corpus": sql("SELECT label, array_to_string(tokens, ' ') AS words, count(*) AS n FROM docs GROUP BY ALL", "docs"),
    "json_two_files": sql(
        "SELECT label, array_to_string(tokens, ' ') AS words, count(*) AS n, count(*) AS n_ids FROM docs GROUP BY ALL", "docs"),
    "csv_vector_scan": """SELECT (label < 5)::INT::DOUBLE AS label, generate_subscripts(embedding, 1) - 1 AS dim,
        unnest(embedding)::DOUBLE AS value FROM embeddings""",
    "stopword_antijoin": sql(
        """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos, token
        FROM toks ANTI JOIN stops USING (token)""", "toks", "stops"),
    "stopword_rows": sql("SELECT doc_id, pos, token FROM toks ANTI JOIN stops USING (token)", "toks", "stops"),
    "flag_filter": f"""SELECT doc_id, pos, token FROM (SELECT doc_id, generate_subscripts({RAW}, 1) - 1 AS pos, unnest({RAW}) AS token
        FROM documents) WHERE {FLAG} <> 'm'""",
    "flag_filter_default": f"""SELECT doc_id, pos, token FROM (SELECT doc_id, generate_subscripts({RAW}, 1) - 1 AS pos, unnest({RAW}) AS token
        FROM documents) WHERE {FLAG} = 'x'""",
    "clean_tokens": sql(
        f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos, token FROM (SELECT doc_id,
        generate_subscripts({RAW}, 1) - 1 AS pos, unnest({RAW}) AS token FROM documents) ANTI JOIN stops USING (token)
        WHERE length(token) > 1 AND {FLAG} <> 'm'""", "stops"),
    "lexicon_segment": sql(
        """SELECT doc_id, len(found) AS n_tokens, array_to_string(found, ' ') AS words FROM (SELECT doc_id,
        regexp_extract_all(regexp_replace(lower(text), '[ \\t\\r\\n]', '', 'g'), (SELECT string_agg(token, '|' ORDER BY length(token) DESC)
        FROM lex)) AS found FROM documents)""",
        "freq", extra={"lex": f"SELECT token FROM freq WHERE n * {LEXICON_SHARE} >= (SELECT sum(n) FROM freq)"}),
    "bag_of_words": sql("SELECT DISTINCT doc_id, token FROM toks", "toks"),
    "word_freq": sql("SELECT token, n FROM freq", "freq"),
    "class_word_freq": sql("SELECT token, n_pos, n_neg, n FROM words", "words"),
    "class_totals": sql("SELECT coalesce(label, 'all') AS label, count(*) AS n FROM ltoks GROUP BY ROLLUP (label)", "ltoks"),
    "bigram_freq": sql("SELECT label, w1, w2, n FROM pairs", "pairs"),
    "bigram_freq_in_doc": sql(
        """SELECT label, w1, w2, count(*) AS n FROM (SELECT label, token AS w1,
        lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS w2 FROM ltoks) WHERE w2 IS NOT NULL GROUP BY ALL""", "ltoks"),
    "doc_bigram_features": sql("SELECT doc_id, feature, n, score, rank FROM best", "toks", extra=DOC_PAIRS),
    "doc_words_bigrams": sql(
        "SELECT doc_id, feature FROM best UNION ALL SELECT DISTINCT doc_id, token FROM toks", "toks", extra=DOC_PAIRS),
    "word_chi2": sql("SELECT token, n_pos, n_neg, n, score FROM word_scores", "word_scores"),
    "top_words": sql("SELECT feature, rank, score FROM top", "top"),
    "bigram_chi2_top": sql("SELECT label, w1, w2, n, n1, n2, score, rank FROM top_pairs", "top_pairs"),
    "word_bigram_scores": sql("SELECT feature, n_pos, n_neg, n, score FROM mixed_scores", "mixed_scores"),
    "word_bigram_scores_negative": sql(
        "SELECT feature, n_pos, n_neg, n, score FROM mixed_scores", "mixed_scores", mixed="mixed_neg"),
    "main_features": sql("SELECT feature, rank, 'selected' AS source FROM selected", "selected"),
    "feature_projection": sql(
        """SELECT doc_id, label, feature FROM bags WHERE feature IN (SELECT w1 FROM selected WHERE w2 IS NULL)""", "bags", "selected"),
    "feature_projection_bigrams": sql(
        """SELECT doc_id, label, feature FROM bags WHERE feature IN (SELECT w1 FROM selected WHERE w2 IS NULL) UNION ALL
        SELECT DISTINCT doc_id, label, w1 || ' ' || p.w2 FROM (SELECT doc_id, label, token AS w1,
        lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS w2 FROM ltoks) p SEMI JOIN selected s USING (w1, w2)""",
        "bags", "selected"),
    "nearest_words": sql(
        "SELECT query, word, cosine, rank FROM (" + NEAR + ")", "wv", "top",
        extra={"picked": "SELECT word, vec FROM wv SEMI JOIN top ON feature = word"}, q="picked"),
    "nearest_words_lsh": sql(
        "SELECT count(DISTINCT query) AS n_queries, count(*) AS n_exact, true AS enough FROM (" + NEAR + ")", "wv", "top",
        extra={"picked": "SELECT word, vec FROM wv SEMI JOIN top ON feature = word"}, q="picked"),
    "expand_features_pairs": sql(
        """SELECT feature, min(rank)::INT AS rank, CASE WHEN bool_or(own) THEN 'selected' ELSE 'expanded' END AS source FROM (
        SELECT w1 || ' ' || w2 AS feature, rank, true AS own FROM chosen UNION ALL SELECT word, rank, false FROM near) GROUP BY feature""",
        "wv", "top_pairs",
        extra={
            "chosen": "SELECT w1, w2, min(rank) AS rank FROM top_pairs WHERE rank <= 50 GROUP BY w1, w2",
            "u": "SELECT word, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS vec FROM wv",
            "asked": """SELECT c.w1, c.w2, c.rank, list_transform(range(1, len(a.vec) + 1), lambda i: (a.vec[i] + b.vec[i]) / 2) AS vec
        FROM chosen c JOIN u a ON a.word = c.w1 JOIN u b ON b.word = c.w2""",
            "near": """SELECT q.rank, v.word, round(list_cosine_similarity(q.vec, v.vec), 6) AS cosine FROM asked q
        JOIN wv v ON v.word <> q.w1 AND v.word <> q.w2 QUALIFY row_number() OVER (PARTITION BY q.w1, q.w2 ORDER BY cosine DESC, v.word) <= 10""",
        }),
    "expand_features": sql(
        """SELECT feature, min(rank) AS rank, CASE WHEN bool_or(own) THEN 'selected' ELSE 'expanded' END AS source FROM (
        SELECT feature, rank, true AS own FROM selected UNION ALL
        SELECT n.word, s.rank, false FROM near n JOIN selected s ON s.w1 = n.query AND s.w2 IS NULL) GROUP BY feature""",
        "wv", "selected",
        extra={"picked": "SELECT word, vec FROM wv SEMI JOIN selected ON w1 = word AND w2 IS NULL", "near": NEAR}, q="picked"),
    "sentence_vector": sql(
        f"""SELECT d.doc_id, d.dim, round(coalesce(s.v, 0.0), 4) AS value
        FROM (SELECT doc_id, unnest(range({DIM})) AS dim FROM documents) d LEFT JOIN (
          SELECT doc_id, dim, sum(times * v) AS v FROM (SELECT doc_id, token AS word, count(*) AS times FROM toks GROUP BY ALL)
          JOIN (SELECT word, generate_subscripts(vec, 1) - 1 AS dim, unnest(vec) AS v FROM wv) USING (word) GROUP BY doc_id, dim
        ) s ON s.doc_id = d.doc_id AND s.dim = d.dim""", "wv", "toks"),
    "relabel_null": "SELECT doc_id, CASE WHEN quality = 1 THEN 'n' END AS label FROM labels",
    "label_encode": "SELECT doc_id, (quality = 1)::INT::DOUBLE AS label FROM labels",
    "union_classes": f"SELECT doc_id, label FROM {CLASSES}",
    "row_counts": f"SELECT coalesce(label, 'all') AS label, count(*) AS n FROM {CLASSES} GROUP BY ROLLUP (label)",
    "split_90_10": f"""SELECT doc_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5(doc_id || '-42'), doc_id)
        <= floor(0.9::DOUBLE * count(*) OVER (PARTITION BY label)) THEN 'train' ELSE 'test' END AS part FROM {CLASSES}""",
    "shuffle_order": f"SELECT doc_id, label, row_number() OVER (ORDER BY md5(doc_id || '-42'), doc_id) AS position FROM {CLASSES}",
    "random_split": f"""SELECT doc_id, label, CASE WHEN ('0x' || substr(md5(doc_id || '-42'), 1, 8))::BIGINT < 3435973836
        THEN 'train' ELSE 'test' END AS part FROM {CLASSES}""",
    "attach_label": sql("SELECT doc_id, label, feature FROM bags SEMI JOIN top USING (feature)", "bags", "top"),
    "mnb_predict": sql(BY_DOC + FROM_DOCS.format(m="mnb", b="mnb_bias"), "present", "mnb", "mnb_bias"),
    "bnb_predict": sql(BY_DOC + FROM_DOCS.format(m="bnb", b="bnb_bias"), "present", "bnb", "bnb_bias"),
    "mnb_all_words": sql(
        BY_DOC + FROM_DOCS.format(m="mnb", b="mnb_bias"), "all_counts", "present", "mnb", "mnb_bias", counts="all_counts"),
    "mnb_accuracy": sql(f"SELECT {DIV.format('tp + tn', 'tp + fp + tn + fn')} AS accuracy FROM confusion", "confusion"),
    "mnb_error_rate": sql(f"SELECT {DIV.format('fp + fn', 'tp + fp + tn + fn')} AS error_rate FROM confusion", "confusion"),
    "mnb_auc_hard": sql(f"SELECT {AUC} AS auc_hard FROM confusion", "confusion"),
    "mnb_roc_points": sql(
        f"""SELECT 0 AS point, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr UNION ALL
        SELECT 1, {DIV.format('fp', 'fp + tn')}, {DIV.format('tp', 'tp + fn')} FROM confusion UNION ALL SELECT 2, 1.0, 1.0""", "confusion"),
    "mnb_confusion": sql(
        f"""SELECT tp, fp, tn, fn, {DIV.format('tp', 'tp + fp')} AS precision, {DIV.format('tp', 'tp + fn')} AS recall,
        {DIV.format('2 * tp', '2 * tp + fp + fn')} AS f1 FROM confusion""", "confusion"),
    "predict_text": sql(
        BY_TURN + FROM_TURNS.replace("{t}", "SELECT conv_id, turn, feature FROM ctoks, (SELECT feature AS token) "
        f"WHERE {FLAG} <> 'm' AND feature NOT IN (SELECT token FROM stops)"),
        "ctoks", "stops", "mnb", "mnb_bias", pattern="[\\p{L}\\p{N}]+"),
    "predict_unspaced": sql(
        BY_TURN + FROM_TURNS.replace("{t}", "SELECT DISTINCT conv_id, turn, feature FROM cut "
        "WHERE length(feature) > 2 AND feature NOT IN (SELECT token FROM stops)"),
        "freq", "stops", "mnb", "mnb_bias",
        extra={"lex": f"SELECT token FROM freq WHERE n * {LEXICON_SHARE} >= (SELECT sum(n) FROM freq)",
               "cut": """SELECT conv_id, turn, unnest(regexp_extract_all(lower(regexp_replace(text, '[ \\t\\r\\n]', '', 'g')),
        (SELECT string_agg(token, '|' ORDER BY length(token) DESC) FROM lex))) AS feature FROM conversations"""}),
    "sentiment_held_out": sql(
        f"SELECT tp, fp, tn, fn, {AUC} AS auc_hard FROM (" + PARTS["confusion"].replace("FROM scored", "FROM hscored") + ")",
        "wv", "selected", "bags", "mnb_bias", counts="hcounts", q="picked",
        only=""" QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5(c.doc_id || '-42'), c.doc_id)
        <= floor(0.9::DOUBLE * count(*) OVER (PARTITION BY label))""",
        extra={
            "picked": "SELECT word, vec FROM wv SEMI JOIN selected ON w1 = word AND w2 IS NULL", "near": NEAR,
            "feats": "SELECT w1 AS feature FROM selected WHERE w2 IS NULL UNION SELECT word FROM near",
            "hcounts": PARTS["fcounts"].replace("SEMI JOIN top", "SEMI JOIN feats"), "hmnb": PARTS["mnb"],
            "tests": """SELECT c.doc_id, CASE WHEN l.quality = 1 THEN 'pos' ELSE 'neg' END AS label, c.tokens
        FROM corpus c JOIN labels l USING (doc_id) ANTI JOIN docs USING (doc_id)""",
            "tbags": "SELECT DISTINCT doc_id, unnest(tokens) AS feature FROM tests",
            "hscored": PARTS["scored"].replace("docs d", "tests d").replace("bags b", "tbags b").replace("JOIN mnb U", "JOIN hmnb U"),
        }),
    "predict_tokens": sql(BY_TURN + FROM_TURNS.replace("{t}", "SELECT * FROM ctoks"), "ctoks", "mnb", "mnb_bias"),
    "feature_count_sweep": sql(
        f"SELECT model, k, {AUC} AS auc_hard FROM series", "docs", "bags", "top", "fcounts", "bnb", "sizes",
        extra=SWEEP_MNB | SWEEP_BNB | {"says": SAYS_MNB + " UNION ALL " + SAYS_BNB, "series": PARTS["series"]}),
    "best_feature_count": sql(
        f"SELECT {AUC} AS auc_hard, k FROM series ORDER BY 1 DESC, k LIMIT 1", "docs", "bags", "top", "fcounts", "sizes",
        extra=SWEEP_MNB | {"says": SAYS_MNB, "series": PARTS["series"]}),
    "all_words_lr": sql(
        """SELECT (SELECT count(*) FROM all_counts) AS n_words, (dp + dn)::BIGINT AS n_docs, true AS converged,
        round(sqrt(sum(((n_pos - n_neg) / (2 * (dp + dn))) ** 2) + any_value(((dp - dn) / (2 * (dp + dn))) ** 2)), 6) AS first_gradient
        FROM all_counts, sizes GROUP BY dp, dn""", "all_counts", "sizes"),
    "features_roundtrip": sql("SELECT feature, rank, 'selected' AS source FROM selected", "selected"),
    "model_roundtrip": """SELECT model, count(*) AS n, count(*) AS same FROM labels SEMI JOIN documents USING (doc_id),
        (SELECT unnest(['MultinomialNB', 'LogisticRegression', 'SVC']) AS model) GROUP BY model""",
    "load_or_build": """SELECT 'BernoulliNB' AS model, count(*) AS n, count(*) AS same FROM labels SEMI JOIN documents USING (doc_id)""",
    "score_documents_stream": sql(BY_DOC + FROM_DOCS.format(m="mnb", b="mnb_bias"), "present", "mnb", "mnb_bias"),
}
