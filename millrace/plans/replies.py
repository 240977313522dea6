"""Queries of the text expressions: tags, formats, molecule strings, feature names and phrases, over texts made of the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import records, text
from millrace.functions.vocabulary import PHRASES
from millrace.operators import matrix, mixing, rollout
from millrace.operators.scoring import bad_features, lookup, normalized_features, phrase_features
from millrace.plans.corpus import table

_ONE_LINE = r"[\t\n\x0B\f\r ]+"


def _pick(key: Column, *cases: str | Column) -> Column:
    """The case of a row's number modulo their count."""
    return F.element_at(F.array(*(F.lit(c) if isinstance(c, str) else c for c in cases)), (key % len(cases) + 1).cast("int"))


def tag_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, each on one line behind a tag, among other lines; every third has no molecule line."""
    said = F.regexp_replace("text", _ONE_LINE, " ")
    reply = F.concat(F.lit("intro\n  reasoning： "), said, F.lit("\n"), F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("Optimized-SMILES: C"), "doc_id", F.lit(" \nReasoning: later"))).otherwise("end"))
    return table(spark, sf_dir, "documents").select("doc_id", text.tag_line(reply, text.REASONING).alias("reasoning"), text.tag_line(reply, text.SMILES).alias("smiles"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of documents, and the molecule that each asks about in the three readings."""
    user = F.concat(F.lit("  Original SMILES: C"), "doc_id", F.lit(" x\nmore: "), F.col("text"))
    asked = text.prompt("lang", user)
    found = [text.original_smiles(user, v).alias(v) for v in ("token", "colon", "line")]
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(asked.cast("binary")).alias("prompt_md5"), *found)


def reply_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of six kinds, of which three are well formed, gated with their rewards."""
    own = F.concat(F.lit("C"), F.col("event_id").cast("string"))
    good = lambda lead, end: F.concat(F.lit(lead + "Reasoning: less N \nOptimized_SMILES: "), own, F.lit(end))
    reply = _pick(F.col("event_id"), good("", "\n<END>"), good("a\nb</THINK>\n", ""), F.lit("Reasoning: only"), F.concat(F.lit("Reasoning: r\nOptimized_SMILES: "), own, F.lit(" C")), F.lit(None).cast("string"), good("", ""))
    raw = F.when(F.col("event_id") % 12 != 5, F.col("value") / 5)
    return rollout.gated(table(spark, sf_dir, "events").select("event_id", reply.alias("answer"), raw.alias("raw_reward"))).select("event_id", "ok_format", "reasoning", "smiles", F.round("reward", 6).alias("reward"))


def reply_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of five kinds read leniently; of several molecules the first longest."""
    n = F.col("event_id").cast("string")
    reply = _pick(
        F.col("event_id"),
        F.concat(F.lit("reasoning : because "), n, F.lit("\n\nOptimized SMILES: C.CCC"), n, F.lit(".CCC"), n, F.lit(" <end>")),
        F.concat(F.lit("REASONING: a\nb\nsmiles: (C)"), n, F.lit("; rest")), F.concat(F.lit("Optimized_SMILES: C"), n, F.lit("。\nReasoning: last <END>")),
        F.concat(F.lit("nothing "), n), F.lit(None).cast("string"),
    )
    return table(spark, sf_dir, "events").select("event_id", text.lenient_output(reply).alias("r")).select("event_id", "r.*")


_MOLECULES = ("C(C)N", "C(C", "c1ccccc1", "C1CC", "C C", "", "CC(=O)[O-]/C", ")(")


def smiles_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sanity and rewrites of molecules of eight kinds."""
    s = _pick(F.col("p_partkey"), *_MOLECULES)
    return table(spark, sf_dir, "part").select("p_partkey", text.smiles_sane(s).alias("sane"), F.concat_ws("|", records.smiles_variants(F.concat(s, F.lit("@.x")))).alias("variants"))


def component_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three molecules, one of them not sane, by length, by place and by a score of one's own (the number of C)."""
    s = F.concat(F.lit("CC.NNNN."), F.when(F.col("p_partkey") % 2 == 0, "CCCCC(").otherwise("CCC"), F.lit(". "), F.col("p_partkey").cast("string"))
    carbons = lambda x: F.length(x) - F.length(F.replace(x, F.lit("C"), F.lit("")))
    letters = lambda x: F.rlike(x, F.lit("^[CN]+$"))
    return table(spark, sf_dir, "part").select("p_partkey", text.chosen_component(s, valid=letters).alias("longest"), text.chosen_component(s, "first", valid=letters).alias("first"), text.chosen_component(s, "carbons", carbons, letters).alias("carbons"))


def alias_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of a plain alias in whole texts, and the first of one that isn't plain."""
    word, mark = records.alias_spans("text", "The"), records.alias_spans("text", "e,")
    total = lambda spans, part: F.aggregate(F.transform(spans, lambda s: s[part].cast("long")), F.lit(0).cast("long"), lambda n, x: n + x)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(word).alias("n"), total(word, "start").alias("starts"), total(word, "end").alias("ends"), F.get(mark, F.lit(0))["start"].alias("mark"))


def reasoning_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands between the tags, or the fallback."""
    said = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("x Reasoning: "), F.col("text"), F.lit(" Optimized_SMILES: C"))).otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.reasoning_slice(said, "source").cast("binary")).alias("slice_md5"))


def vina_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The affinity in a pose's remark; other remarks and poses without one give 0."""
    pose = F.when(F.col("l_linenumber") != 3, F.concat(F.lit("MODEL 1\nREMARK VINA RESULT:   -"), F.col("l_discount").cast("string"), F.lit("  0.000  0.000\nREMARK VINA RESULT: 9"))).otherwise("REMARK other")
    return table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.count("*").alias("n"), F.round(F.sum(text.vina_affinity(pose)), 4).alias("affinity"))


def target_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target specifications, a row each."""
    return matrix.targets_of(spark, ["5F19:cox2.pdbqt:cox2.json", "6Y3C:cox1.pdbqt:cox1.json"])


def structural_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between descriptors made of a part's columns, by the thresholds."""
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice").cast("double")
    before = {"mw": price, "logp": size / 10, "hbd": size % 3, "rings": size % 2}
    after = {"mw": price + size % 4, "logp": size / 10 + (size % 5) / 20, "hbd": F.lit(1.0), "rings": size % 2}
    return table(spark, sf_dir, "part").select("p_partkey", matrix.difference_text(before, after).alias("difference"))


#: Names as they come, and as they go.
_NAMES = {
    "CYP3A4 inhibitor": "CYP3A4 inhibitor", "3a4 inhibitor": "CYP3A4 inhibitor", "nRot": "Flexibility", "Drug-induced_Neurotoxicity": "Toxicity: Drug-induced Neurotoxicity",
    "AMES_Toxicity": "AMES Toxicity", "log<sub>S</sub>": "logS", "Unknown-Name": "Unknown Name", "LogP": "logP",
    "Hepatotoxicity": "Human Hepatotoxicity", "mutagenicity": "Toxicity: AMES Toxicity", "mutagenic": "Genotoxicity", "hERG": "hERG Blockers", "CLogP": "logP",
    "溶解度": "logS", "人类 肝毒性": "Toxicity: Human Hepatotoxicity", "致癌性": "Toxicity: Carcinogenicity", "Eye Irritation": "Toxicity: Eye Irritation",
    "CYP2D6": "CYP2D6 substrate", "IG C50": "IGC50", "hepatic injury": "DILI", "HBD": "HBD (nHD)", "nHD": "HBD (nHD)", "drug-induced liver injury": "Toxicity: DILI",
    "未知": "未知", "Molecular Weight（MW）": "Molecular Weight (MW)", "fsp<sup>3</sup>": "Fsp3", "T1/2": "T1/2", "bms 规则": "BMS Rule", "xlogp": "xlogp",
}


def property_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two properties of each order under many kinds of names; of two that become one name the later wins."""
    raw = _pick(F.col("o_orderkey"), F.concat(F.lit(">"), F.col("o_custkey").cast("string"), F.lit(" nM")), F.col("o_custkey").cast("string"), F.lit("++-"))
    names = list(_NAMES)
    two = F.array(F.struct(_pick(F.col("o_orderkey"), *names).alias("name"), raw.alias("raw"), F.lit(0).alias("pos")), F.struct(_pick(F.col("o_orderkey") + 1, *names).alias("name"), F.lit("7%").alias("raw"), F.lit(1).alias("pos")))
    props = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"), F.lit("orig").alias("role"), F.explode(two).alias("p")).select("sample_id", "role", "p.*")
    return normalized_features(props).select("sample_id", "role", "feature", F.round("value", 6).alias("value"))


def phrase_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The known phrases in whole texts, of which each document has two more."""
    known = list(dict.fromkeys(p for p, _, _ in PHRASES))
    said = F.concat(F.col("text"), F.lit(" We saw "), _pick(F.col("doc_id"), *known), F.lit(" and "), F.upper(_pick(F.col("doc_id") * 7 + 3, *known)))
    return phrase_features(table(spark, sf_dir, "documents").select("doc_id", said.alias("text")), id_col="doc_id")


def ask_client(smiles: str) -> dict:
    """A stand-in for a property oracle: it fails for names with an A at the start."""
    if smiles.startswith("A"):
        raise ConnectionError(smiles)
    return {"length": len(smiles)}


def property_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of distinct names by a client, end marks taken off; failures give none."""
    names = table(spark, sf_dir, "nation").select(F.concat("n_name", _pick(F.col("n_nationkey"), "", " <END>")).alias("smiles"))
    return lookup(names.union(names), ask_client, tries=1).select("smiles", F.try_element_at("props", F.lit("length")).cast("int").alias("length"))


def bad_feature_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line quantities that break the rule of their return flag."""
    rules = spark.createDataFrame([("A", ">", 30.0, None), ("N", "between", 10.0, 40.0), ("R", "<=", 12.0, None), ("R", ">=", 49.0, None)], "feature string, flag string, threshold double, upper double")
    features = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sample_id"), F.lit("opt").alias("role"), F.col("l_returnflag").alias("feature"), F.col("l_quantity").cast("double").alias("value"))
    return bad_features(features, rules)


def sentence_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents up to the one with which their sentences reach 5000 (the cap is the feature)."""
    counted = table(spark, sf_dir, "documents").select("doc_id", F.size(text.sentences("text")).alias("n_sentences"))
    return mixing.until_cap(counted, "n_sentences", [], "doc_id", 5000, span=1000)


def record_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of open records of three kinds."""
    n = F.col("p_partkey").cast("string")
    out = F.concat(F.lit("Reasoning: r"), n, F.lit("\nOptimized_SMILES: C"), n)
    record = _pick(F.col("p_partkey"), F.create_map(F.lit("output"), out, F.lit("My_SMILES"), F.concat(F.lit(" N"), n)), F.create_map(F.lit("output"), F.lit(" "), F.lit("the reasoning"), F.concat(F.lit(" q"), n)), F.create_map(F.lit("output"), out))
    return table(spark, sf_dir, "part").select("p_partkey", record.alias("r")).select("p_partkey", records.predicted_smiles(F.col("r")).alias("predicted"), records.optimized_smiles(F.col("r")).alias("optimized"), records.record_reasoning(F.col("r")).alias("reasoning"))


def first_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4: the first document of each text."""
    return mixing.keep_first(table(spark, sf_dir, "documents"), ["text"], "doc_id").select("doc_id", "lang", "source")


def reasoning_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P25: the keyword score with its four lists, of texts that hold some of the keywords."""
    said = F.concat(F.col("text"), _pick(F.col("doc_id"), " toxicity and lack; reduce the ring", " 毒性 问题 优化 官能团 策略", " tpsa logp bond atom remove add design", ""))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(records.reasoning_quality(said), 6).alias("quality"))


QUERIES = {
    f.__name__: f
    for f in (
        tag_lines, prompts, reply_gate, reply_parse, smiles_checks, component_choice, alias_hits, reasoning_slices, vina_parse, target_specs, structural_difference,
        property_normalised, phrase_directions, property_lookup, bad_feature_rules, sentence_cap, record_fields, first_copies, reasoning_quality,
    )
}


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^[\s\p{{Z}}\x0B\x1c-\x1f\x85]+|[\s\p{{Z}}\x0B\x1c-\x1f\x85]+$', '', 'g')"


def _sql_list(items) -> str:  # noqa: ANN001
    return "[" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + "]"


def _named_phrases() -> list[tuple[str, str, str, int]]:
    """The phrases with the names their features go by: what an alias, a merge or its letters alone change is stated here."""
    renamed = {"nHD": "HBD (nHD)", "nHA": "HBA (nHA)", "SAScore": "SAscore", "Eye Irritation": "Toxicity: Eye Irritation"}
    named = {p: (renamed.get(f, f), d) for p, f, d in PHRASES}
    return [(p, f, d, k) for k, (p, (f, d)) in enumerate(named.items())]


def _quality_sql(said: str) -> str:
    lists = (records.PROBLEM_KEYWORDS, records.SOLUTION_KEYWORDS, records.CHEMICAL_KEYWORDS, records.STRATEGY_KEYWORDS)
    parts = [f"least(len(list_filter({_sql_list(k)}, lambda k: contains(lower({said}), k))) / {len(k)}::DOUBLE * 2, 1.0)" for k in lists]
    return f"least(({' + '.join(parts)}) / 4 + least(length({said}) / 500, 0.2), 1.0)"


_PHRASE_LIST = _sql_list(dict.fromkeys(p for p, _, _ in PHRASES))
_PARTS = r"regexp_split_to_array(lower(text), '\bthe\b')"
ORACLE_SQL = {
    "tag_lines": "SELECT doc_id, " + _strip(r"regexp_replace(text, '[\t\n\x0B\f\r ]+', ' ', 'g')") + " AS reasoning, CASE WHEN doc_id % 3 <> 0 THEN 'C' || doc_id ELSE '' END AS smiles FROM documents",
    "prompts": f"""
        SELECT doc_id, md5('System: ' || coalesce(lang, '') || chr(10) || 'User: ' || coalesce('  Original SMILES: C' || doc_id || ' x' || chr(10) || 'more: ' || text, '') || chr(10) || 'Assistant: ') AS prompt_md5,
            CASE WHEN text IS NULL THEN '' ELSE 'C' || doc_id END AS token, CASE WHEN text IS NULL THEN '' ELSE 'C' || doc_id || ' x' END AS colon, CASE WHEN text IS NULL THEN '' ELSE 'C' || doc_id || ' x' END AS line FROM documents""",
    "reply_gate": """
        WITH r AS (SELECT event_id, event_id % 6 IN (0, 1, 5) AS ok, CASE WHEN event_id % 12 <> 5 THEN value / 5 END AS raw FROM events)
        SELECT event_id, ok AS ok_format, CASE WHEN ok THEN 'less N' ELSE '' END AS reasoning, CASE WHEN ok THEN 'C' || event_id ELSE '' END AS smiles,
            round(CASE WHEN NOT ok OR raw IS NULL THEN -2.0 ELSE greatest(least(raw, 10.0), -10.0) END, 6)::DOUBLE AS reward FROM r""",
    "reply_parse": """
        SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'because ' || event_id WHEN 1 THEN 'a' || chr(10) || 'b' WHEN 2 THEN 'last' ELSE '' END AS reasoning,
            CASE event_id % 5 WHEN 0 THEN 'CCC' || event_id WHEN 1 THEN '(C)' || event_id WHEN 2 THEN 'C' || event_id ELSE '' END AS smiles FROM events""",
    "smiles_checks": "SELECT p_partkey, [true, false, true, false, false, false, true, false][p_partkey % 8 + 1] AS sane, "
    + _sql_list(["C(C)N@.x|C(C)N.x|C(C)N@", "C(C@.x|C(C.x|C(C@", "c1ccccc1@.x|c1ccccc1.x|c1ccccc1@", "C1CC@.x|C1CC.x|C1CC@", "C C@.x|CC@.x|C C.x|C C@", "@.x|.x|@", "CC(=O)[O-]/C@.x|CC(=O)[O-]C.x|CC(=O)[O-]/C@|CC(=O)/C@.x", ")(@.x|)(.x|)(@"])
    + "[p_partkey % 8 + 1] AS variants FROM part",
    "component_choice": "SELECT p_partkey, 'NNNN' AS longest, CASE WHEN p_partkey % 2 = 0 THEN 'NNNN' ELSE 'CCC' END AS first, CASE WHEN p_partkey % 2 = 0 THEN 'CC' ELSE 'CCC' END AS carbons FROM part",
    "alias_hits": f"""
        WITH p AS (SELECT doc_id, lower(text) AS low, {_PARTS} AS parts FROM documents),
        m AS (SELECT *, len(parts) - 1 AS n, list_sum(list_transform(range(1, len(parts)), lambda i: length(parts[i]) * (len(parts) - i))) AS before FROM p)
        SELECT doc_id, n::INT AS n, (coalesce(before, 0) + 3 * n * (n - 1) // 2)::BIGINT AS starts, (coalesce(before, 0) + 3 * n * (n - 1) // 2 + 3 * n)::BIGINT AS ends, CASE WHEN contains(low, 'e,') THEN (strpos(low, 'e,') - 1)::INT END AS mark FROM m""",
    "reasoning_slices": f"""
        SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 AND text IS NOT NULL THEN {_strip("split_part(split_part('x Reasoning: ' || text || ' Optimized_SMILES: C', 'Reasoning:', 2), 'Optimized_SMILES:', 1)")} ELSE coalesce(source, '') END) AS slice_md5 FROM documents""",
    "vina_parse": "SELECT l_linenumber, count(*) AS n, round(sum(CASE WHEN l_linenumber = 3 THEN 0 ELSE -l_discount END), 4)::DOUBLE AS affinity FROM lineitem GROUP BY 1",
    "target_specs": "SELECT * FROM (VALUES ('5F19', 'cox2.pdbqt', 'cox2.json', 0), ('6Y3C', 'cox1.pdbqt', 'cox1.json', 1)) t(target, receptor, box, place)",
    "structural_difference": """
        WITH d AS (SELECT p_partkey, p_retailprice::DOUBLE AS w, (p_retailprice + p_size % 4)::DOUBLE AS w2, p_size / 10::DOUBLE AS l, p_size / 10::DOUBLE + (p_size % 5) / 20::DOUBLE AS l2, (p_size % 3)::DOUBLE AS h, 1.0::DOUBLE AS h2 FROM part),
        t AS (SELECT p_partkey, concat_ws(chr(10), CASE WHEN abs(w2 - w) > 1 THEN 'MW: ' || format('{:,.2f}', w) || ' -> ' || format('{:,.2f}', w2) END, CASE WHEN abs(l2 - l) > 0.1 THEN 'logP: ' || format('{:,.2f}', l) || ' -> ' || format('{:,.2f}', l2) END,
            CASE WHEN abs(h2 - h) > 0 THEN 'HBD: ' || format('{:,.2f}', h) || ' -> ' || format('{:,.2f}', h2) END) AS text FROM d)
        SELECT p_partkey, CASE WHEN text = '' THEN 'No structural change' ELSE text END AS difference FROM t""",
    "property_normalised": f"""
        WITH x AS (SELECT o_orderkey, unnest([0, 1]) AS pos, o_custkey FROM orders),
        y AS (SELECT o_orderkey AS sample_id, {_sql_list(_NAMES.values())}[(o_orderkey + pos) % {len(_NAMES)} + 1] AS feature, pos,
            CASE WHEN pos = 1 THEN 7.0 WHEN o_orderkey % 3 = 0 THEN o_custkey / 1000::DOUBLE WHEN o_orderkey % 3 = 1 THEN o_custkey ELSE 1.0 END::DOUBLE AS value FROM x)
        SELECT sample_id, 'orig' AS role, feature, round(arg_max(value, pos), 6)::DOUBLE AS value FROM y GROUP BY sample_id, feature""",
    "phrase_directions": f"""
        WITH t AS (SELECT doc_id, lower(text || ' We saw ' || {_PHRASE_LIST}[doc_id % len({_PHRASE_LIST}) + 1] || ' and ' || upper({_PHRASE_LIST}[(doc_id * 7 + 3) % len({_PHRASE_LIST}) + 1])) AS low FROM documents)
        SELECT doc_id, feature, arg_min(direction, pos) AS direction FROM t JOIN (VALUES """ + ", ".join(str(p) for p in _named_phrases()) + ") p(phrase, feature, direction, pos) ON contains(low, phrase) GROUP BY doc_id, feature",
    "property_lookup": "SELECT n_name AS smiles, CASE WHEN NOT starts_with(n_name, 'A') THEN length(n_name)::INT END AS length FROM nation",
    "bad_feature_rules": """
        SELECT DISTINCT l_orderkey AS sample_id, 'opt' AS role, l_returnflag AS feature FROM lineitem
        WHERE (l_returnflag = 'A' AND l_quantity > 30) OR (l_returnflag = 'N' AND NOT l_quantity BETWEEN 10 AND 40) OR (l_returnflag = 'R' AND (l_quantity <= 12 OR l_quantity >= 49))""",
    "sentence_cap": r"""
        WITH n AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[\n\.!?]\s+'), lambda s: length(trim(s)) >= 8))::INT AS n_sentences FROM documents),
        b AS (SELECT *, coalesce(sum(n_sentences) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n)
        SELECT doc_id, n_sentences FROM b WHERE before < 5000""",
    "record_fields": """
        SELECT p_partkey, [' N' || p_partkey, '', 'C' || p_partkey][p_partkey % 3 + 1].trim() AS predicted, CASE WHEN p_partkey % 3 = 1 THEN '' ELSE 'C' || p_partkey END AS optimized,
            CASE WHEN p_partkey % 3 = 1 THEN 'q' ELSE 'r' END || p_partkey AS reasoning FROM part""",
    "first_copies": "SELECT min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, arg_min(source, doc_id) AS source FROM documents GROUP BY text",
    "reasoning_quality": f"SELECT doc_id, round({_quality_sql('said')}, 6)::DOUBLE AS quality FROM (SELECT doc_id, text || [' toxicity and lack; reduce the ring', ' 毒性 问题 优化 官能团 策略', ' tpsa logp bond atom remove add design', ''][doc_id % 4 + 1] AS said FROM documents)",
}
