"""Text, items, evaluation and analysis operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers, hashing, text
from ..operators import analysis as S
from ..operators import audio as A
from ..operators import items as I
from ..operators import recognition as Q
from ..operators import runner as R
from ..operators import wer
from ..operators.ledger import ledger
from ..config import AnalysisConfig
from ..sources.corpus import fetch, footprint, index_shards
from .bindings import RECORDS, SEED, SPEAKERS, TRIALS, records, speakers, table
from .registry import registry

QUERIES, ORACLE_SQL, query = registry()
#: Draws of the queries that have SQL, and of the gap tables, as configured.
DRAWS, RESAMPLES = 50, AnalysisConfig().n_resamples


def _trials(spark, d):
    return S.trials(records(spark, d), speakers(spark, d)).where("drop_reason is null")


# ---- text

_HESITATIONS = ", ".join(f"'{w}'" for w in text.HESITATIONS)
#: The rules in SQL, but for spelled numbers, of which these texts have none.
_RULES = rf"""r AS (SELECT conv_id, turn, nfc_normalize(text) AS t1 FROM conversations), r2 AS (SELECT *, lower(t1) AS t2 FROM r), r3 AS (SELECT *, regexp_replace(t2, '\[[^\]]*\]|\([^)]*\)|<[^>]*>', ' ', 'g') AS t3 FROM r2),
r5 AS (SELECT *, regexp_replace(regexp_replace(t3, '[''’`´"]', '', 'g'), '[^\p{{L}}\p{{Nd}}\s]', ' ', 'g') AS t5 FROM r3),
r6 AS (SELECT *, array_to_string(list_filter(string_split_regex(t5, '\s+'), lambda w: w <> '' AND w NOT IN ({_HESITATIONS})), ' ') AS t6 FROM r5)"""


@query(f"WITH {_RULES} SELECT conv_id, turn, t6 AS normalized FROM r6")
def text_normalized(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.normalize(F.col("text")).alias("normalized"))


@query(f"WITH {_RULES} SELECT conv_id, turn, unnest({list(text.RULES)}) AS rule, unnest([t1, t2, t3, t3, t5, t6, t6]) AS text FROM r6")
def text_trace(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.explode(text.trace(F.col("text"))).alias("t")).select("conv_id", "turn", "t.*")


@query(r"SELECT event_id, trim(regexp_replace(regexp_replace('ah ' || event_type || ' (x)  <y> hm [' || value || ']  fim', '\[[^\]]*\]|\([^)]*\)|<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS untagged, event_type || ' fim' AS plain FROM events")
def text_native_rules(spark, d):
    raw = F.concat(F.lit("ah "), "event_type", F.lit(" (x)  <y> hm ["), F.col("value").cast("string"), F.lit("]  fim"))
    untagged = text.collapsed(text.without_tags(raw))
    return table(spark, d, "events").select("event_id", untagged.alias("untagged"), text.without_hesitations(untagged).alias("plain"))


_ANSWERS = """answers AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN chr(CAST(65 + o_custkey % 5 AS INTEGER)) WHEN 1 THEN '(' || chr(CAST(97 + o_custkey % 5 AS INTEGER)) || ') porque' WHEN 2 THEN 'acho que a Alternativa ' || chr(CAST(65 + o_custkey % 5 AS INTEGER)) || ' serve'
  WHEN 3 THEN 'não sei' WHEN 4 THEN chr(CAST(65 + o_custkey % 5 AS INTEGER)) || ').  ' ELSE ' ' END AS t FROM orders)"""


def _answers(spark, d):
    letter = F.char(65 + F.col("o_custkey") % 5)
    kinds = [letter, F.concat(F.lit("("), F.lower(letter), F.lit(") porque")), F.concat(F.lit("acho que a Alternativa "), letter, F.lit(" serve")), F.lit("não sei"), F.concat(letter, F.lit(").  ")), F.lit(" ")]
    return table(spark, d, "orders").select("o_orderkey", F.element_at(F.array(*kinds), (F.col("o_orderkey") % 6 + 1).cast("int")).alias("t"))


@query(f"""WITH {_ANSWERS}, h AS (SELECT o_orderkey, upper(coalesce(nullif(regexp_extract(trim(t), '^\\(?([A-Ea-e])\\)?[).:\\-\\s]*$', 1), ''), nullif(regexp_extract(trim(t), '^\\(?([A-Ea-e])\\)?[).:\\-]\\s', 1), ''), nullif(regexp_extract(trim(t), '(?i)\\balternativa\\s+\\(?([A-Ea-e])\\)?\\b', 1), ''))) AS label FROM answers)
SELECT o_orderkey, CASE WHEN label IN ('A', 'B', 'C', 'D') THEN label END AS label FROM h""")
def answers_filter_label(spark, d):
    a = _answers(spark, d)
    return a.select("o_orderkey", answers.extract_label(F.col("t"), "ABCD").alias("label"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (0, 1, 2, 4) AND o_custkey % 5 < 4 THEN chr(CAST(65 + o_custkey % 5 AS INTEGER)) END AS label,
CASE WHEN o_orderkey % 6 IN (3, 5) OR o_custkey % 5 = 4 THEN NULL WHEN o_orderkey % 6 IN (0, 4) THEN 'resposta_e_so_a_letra' WHEN o_orderkey % 6 = 1 THEN 'letra_entre_delimitadores' ELSE 'marcador_explicito' END AS strategy,
CASE WHEN o_orderkey % 6 = 5 THEN 'vazio' WHEN o_orderkey % 6 = 3 THEN 'sem_letra' WHEN o_custkey % 5 < 4 THEN NULL WHEN o_orderkey % 6 = 1 THEN 'sem_letra' WHEN o_orderkey % 6 = 2 THEN 'sem_letra' ELSE 'letra_fora_do_vocabulario' END AS reason,
CASE WHEN o_orderkey % 6 IN (3, 5) THEN '' WHEN o_custkey % 5 < 4 THEN chr(CAST(65 + o_custkey % 5 AS INTEGER)) WHEN o_orderkey % 6 IN (0, 4) THEN 'E' ELSE '' END AS candidates FROM orders""")
def answers_label_cascade(spark, d):
    a = _answers(spark, d)
    return a.select("o_orderkey", answers.parse_label(F.col("t"), "ABCD").alias("p")).select("o_orderkey", "p.label", "p.strategy", "p.reason", F.array_join("p.candidates", ",").alias("candidates"))


# ---- hashes

@query(f"SELECT o_orderkey, sha256('{{\"item_id\":\"' || o_orderkey || '\",\"model\":\"m\",\"n\":' || o_custkey || '}}') AS key FROM orders")
def hash_stable(spark, d):
    return table(spark, d, "orders").select("o_orderkey", hashing.stable_hash(item_id=F.col("o_orderkey").cast("string"), model=F.lit("m"), n=F.col("o_custkey")).alias("key"))


def _swap(i: int) -> str:
    return f"list_transform(range(0, 4), lambda k: CASE WHEN k = {i} THEN o[j{i} + 1] WHEN k = j{i} THEN o[{i} + 1] ELSE o[k + 1] END)"


@query(f"""WITH h AS (SELECT o_orderkey, sha256(sha256('{{"item_id":"' || o_orderkey || '","model_key":"m1","seed":{SEED}}}') || ':0') AS s FROM orders),
j AS (SELECT o_orderkey, CAST('0x' || substr(s, 25, 8) AS BIGINT) % 4 AS j3, CAST('0x' || substr(s, 17, 8) AS BIGINT) % 3 AS j2, CAST('0x' || substr(s, 9, 8) AS BIGINT) % 2 AS j1 FROM h),
a AS (SELECT *, [0, 1, 2, 3] AS o FROM j), b AS (SELECT * EXCLUDE o, {_swap(3)} AS o FROM a), c AS (SELECT * EXCLUDE o, {_swap(2)} AS o FROM b), e AS (SELECT * EXCLUDE o, {_swap(1)} AS o FROM c)
SELECT o_orderkey, array_to_string(o, ',') AS permutation FROM e""")
def hash_permutation(spark, d):
    p = hashing.permutation(F.col("o_orderkey").cast("string"), F.lit("m1"), SEED, 4)
    return table(spark, d, "orders").select("o_orderkey", F.array_join(p.cast("array<string>"), ",").alias("permutation"))


@query("SELECT o_orderkey, CAST(CAST('0x' || substr(sha256('7:' || o_orderkey), 1, 16) AS UBIGINT) % 4 AS INTEGER) AS choice FROM orders")
def hash_choice(spark, d):
    return table(spark, d, "orders").select("o_orderkey", hashing.deterministic_choice(F.col("o_orderkey").cast("string"), 7, 4).alias("choice"))


# ---- word errors

@query("""WITH RECURSIVE w AS (SELECT conv_id, turn, [x FOR x IN string_split(regexp_replace(lower(text), '\\s+', ' ', 'g'), ' ') IF x <> ''] AS words FROM conversations),
p AS (SELECT a.conv_id, a.turn, a.words AS r, b.words AS h FROM w a JOIN w b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
c AS (SELECT conv_id, turn, r, h, 0 AS i, range(len(h) + 1) AS cost FROM p
UNION ALL SELECT conv_id, turn, r, h, i + 1, [list_min(t[1:j]) + j - 1 FOR j IN range(1, len(h) + 2)] FROM (SELECT *, list_concat([i + 1], [least(cost[j] + CASE WHEN h[j] = r[i + 1] THEN 0 ELSE 1 END, cost[j + 1] + 1) - j FOR j IN range(1, len(h) + 1)]) AS t FROM c WHERE i < len(r)))
SELECT conv_id, turn, CAST(cost[len(h) + 1] AS BIGINT) AS errors FROM c WHERE i = len(r)""")
def wer_native(spark, d):
    c = table(spark, d, "conversations")
    a, b = c.alias("a"), c.alias("b")
    pairs = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b.turn") == F.col("a.turn") + 1))
    tidy = lambda x: text.collapsed(F.lower(x))
    return pairs.select("a.conv_id", "a.turn", wer.word_errors(tidy(F.col("a.text")), tidy(F.col("b.text"))).alias("errors"))


def _edit_counts(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_returnflag").alias("model_key"), F.col("l_linestatus").alias("region"), F.col("l_suppkey").alias("speaker_code"), F.col("l_linenumber").cast("long").alias("substitutions"), (F.col("l_orderkey") % 3).alias("insertions"), (F.col("l_partkey") % 4).alias("deletions"), (F.col("l_quantity").cast("long") + 9).alias("n_reference_words"))


_EDITS = "e AS (SELECT l_returnflag AS model_key, l_linestatus AS region, l_suppkey AS speaker_code, CAST(l_linenumber AS BIGINT) AS s, l_orderkey % 3 AS i, l_partkey % 4 AS x, CAST(l_quantity AS BIGINT) + 9 AS n FROM lineitem)"


@query(f"WITH {_EDITS} SELECT model_key, region, count(*) AS n_windows, count(DISTINCT speaker_code) AS n_speakers, CAST(sum(s) AS BIGINT) AS substitutions, CAST(sum(i) AS BIGINT) AS insertions, CAST(sum(x) AS BIGINT) AS deletions, CAST(sum(s + i + x) AS BIGINT) AS errors, CAST(sum(n) AS BIGINT) AS n_reference_words, round(sum(s + i + x) / sum(n), 9) AS wer_pooled, round(avg((s + i + x) / n), 9) AS wer_macro FROM e GROUP BY ALL")
def wer_table(spark, d):
    out = wer.rates(_edit_counts(spark, d), ["model_key", "region"])
    return out.withColumns({c: F.round(c, 9) for c in ("wer_pooled", "wer_macro")})


@query(f"""WITH {_RULES}, g AS (SELECT conv_id, turn, text AS t0, string_split(t6, ' ') AS w FROM r6 JOIN conversations USING (conv_id, turn))
SELECT conv_id || ':' || turn AS window_id, conv_id AS speaker_code, 'asr1' AS model_key, CAST(len(regexp_extract_all(t0, '\\bthe\\b')) AS BIGINT) AS substitutions, CAST(0 AS BIGINT) AS insertions, CAST(0 AS BIGINT) AS deletions, CAST(len(w) AS BIGINT) AS n_reference_words, 'v1' AS normalizer_version, CAST(NULL AS VARCHAR) AS drop_reason FROM g""")
def wer_records(spark, d):
    c = table(spark, d, "conversations")
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    ref = c.select(key.alias("window_id"), F.col("text").alias("reference_text"), F.col("conv_id").alias("speaker_code"))
    hyp = c.select(key.alias("window_id"), F.lit("asr1").alias("model_key"), F.regexp_replace("text", r"\bthe\b", "te").alias("text"))
    return wer.records(hyp, ref)


# ---- items

_WINDOWS = "w AS (SELECT o_custkey AS speaker_code, CAST(o_orderkey AS VARCHAR) AS window_id FROM orders)"


def _windows(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("speaker_code"), F.col("o_orderkey").cast("string").alias("window_id"))


@query(f"""WITH {_WINDOWS}, p AS (SELECT a.window_id, b.window_id AS other, row_number() OVER (PARTITION BY a.window_id ORDER BY sha256('{SEED}:' || a.window_id || ':' || b.window_id)) AS r FROM w a JOIN w b ON a.speaker_code = b.speaker_code AND a.window_id <> b.window_id),
c AS (SELECT window_id, string_agg(other, ',' ORDER BY other) AS context FROM p WHERE r <= 3 GROUP BY 1) SELECT w.window_id, coalesce(context, '') AS context FROM w LEFT JOIN c USING (window_id)""")
def items_context(spark, d):
    return I.context_windows(_windows(spark, d), 3, SEED).withColumn("context", F.array_join("context", ","))


@query(f"""WITH {SPEAKERS}, p AS (SELECT DISTINCT region, speaker_code FROM speakers WHERE region IN ('NE', 'SE') AND age BETWEEN 20 AND 69), n AS (SELECT region, count(*) AS available FROM p GROUP BY 1)
SELECT region, speaker_code, available FROM p JOIN n USING (region) QUALIFY row_number() OVER (PARTITION BY region ORDER BY sha256('{SEED}:' || region || ':' || speaker_code)) <= 6""")
def items_pilot(spark, d):
    return I.pilot_speakers(speakers(spark, d), 6, ["NE", "SE"], 20, 69, SEED)


def _generated(spark, d):
    """Generators' answers by rule, sound and unsound, one for each event."""
    e = table(spark, d, "events").select(F.concat(F.lit("w"), F.col("event_id").cast("string")).alias("window_id"), F.col("event_id").alias("i"))
    option = lambda k, right, source: F.concat(F.lit(f'{{"text":"opção {k}","is_correct":{right},"source_window_id":"'), source, F.lit('"}'))
    sound = F.concat(F.lit('{"items":[{"question":"Qual?","alternatives":['), option(1, "true", F.col("window_id")), *[F.concat(F.lit(","), option(k, "false", F.lit(f"c{k}"))) for k in (2, 3, 4)], F.lit("]}]}"))
    kinds = [sound, F.lit(""), F.lit("sem json"), F.lit('{"itens":[]}'), F.lit('{"items":[]}'), F.replace(sound, F.lit('"c3"'), F.lit('"x"')), F.replace(sound, F.lit("opção 4"), F.lit("OPÇÃO 3")), F.concat(F.lit("```json\n"), sound, F.lit("\n```")), F.replace(sound, F.lit("Qual?"), F.lit(" ")), F.replace(sound, F.lit("false"), F.lit("true"))]
    context = F.when(F.col("i") % 11 == 10, F.array().cast("array<string>")).otherwise(F.array(F.lit("c2"), F.lit("c3"), F.lit("c4")))
    return e.select("window_id", context.alias("context"), F.element_at(F.array(*kinds), (F.col("i") % 10 + 1).cast("int")).alias("raw_text"))


@query("""WITH e AS (SELECT CASE WHEN event_id % 11 = 10 THEN 'sem_janelas_de_contexto' ELSE CASE event_id % 10 WHEN 0 THEN 'kept' WHEN 1 THEN 'resposta_vazia' WHEN 2 THEN 'resposta_nao_e_json' WHEN 3 THEN 'envelope_json_invalido' WHEN 4 THEN 'item_faltando_na_resposta'
WHEN 5 THEN 'proveniencia_desconhecida' WHEN 6 THEN 'alternativas_duplicadas' WHEN 7 THEN 'kept' WHEN 8 THEN 'pergunta_vazia' ELSE 'corretas_diferente_de_uma' END END AS reason FROM events) SELECT reason, count(*) AS n FROM e GROUP BY 1""")
def items_generation_ledger(spark, d):
    return ledger(I.validated(_generated(spark, d), 1), "reason")


_SOUND = """e AS (SELECT 'w' || event_id AS w FROM events WHERE event_id % 10 IN (0, 7) AND event_id % 11 <> 10),
v AS (SELECT w, [{'label': 'A', 'text': 'opção 1', 'is_correct': true, 'source_window_id': w}, {'label': 'B', 'text': 'opção 2', 'is_correct': false, 'source_window_id': 'c2'}, {'label': 'C', 'text': 'opção 3', 'is_correct': false, 'source_window_id': 'c3'}, {'label': 'D', 'text': 'opção 4', 'is_correct': false, 'source_window_id': 'c4'}] AS a FROM e)"""


@query(f"WITH {_SOUND} SELECT w || '__i01' AS item_id, 'Qual?' AS question, CAST(to_json(a) AS VARCHAR) AS alternatives FROM v")
def items_validated(spark, d):
    return I.validated(_generated(spark, d), 1).where("reason is null").select("item_id", "question", F.to_json("alternatives").alias("alternatives"))


_FILTER = """runs AS (SELECT l_orderkey AS item_id, l_returnflag AS model_key, l_linestatus = 'F' AS ok, l_quantity > 45 AS unread FROM lineitem),
m AS (SELECT item_id, model_key, count(*) FILTER (ok AND NOT unread) AS c, count(*) FILTER (unread) AS u, count(*) AS n FROM runs GROUP BY ALL),
f AS (SELECT item_id, count(*) FILTER (c >= 2) AS t, CAST(sum(u) AS BIGINT) AS u, string_agg(model_key || '=' || c || '/' || n, ', ' ORDER BY model_key) FILTER (c >= 2) AS why FROM m GROUP BY 1)"""


def _filtered(spark, d):
    raw = F.when(F.col("l_quantity") > 45, "não sei").otherwise(F.when(F.col("l_linestatus") == "F", "A").otherwise("B"))
    runs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_returnflag").alias("model_key"), raw.alias("raw_text"), F.lit("A").alias("correct_label"))
    return I.filter_decisions(I.filter_runs(runs))


@query(f"WITH {_FILTER} SELECT item_id, CASE WHEN t > 0 THEN 'discarded' ELSE 'kept' END AS filter_status, CASE WHEN t > 0 THEN 'respondivel_sem_audio_nem_transcricao: ' || why END AS filter_reason, t AS n_triggering, u AS n_unparsed FROM f")
def items_filter_decisions(spark, d):
    return _filtered(spark, d)


@query(f"WITH {_FILTER} SELECT item_id % 7 AS g, count(*) AS n_items, count(*) FILTER (t > 0) AS n_discarded, count(*) FILTER (t > 0) / count(*) AS discard_rate FROM f GROUP BY 1")
def items_discard_rates(spark, d):
    return I.discard_rates(_filtered(spark, d).withColumn("g", F.col("item_id") % 7), ["g"])


def _sheet(spark, d):
    o = table(spark, d, "orders")
    items = o.select(F.col("o_orderkey").cast("string").alias("item_id"), "o_orderpriority")
    decision = F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "O", "rejected").otherwise("talvez")
    sheet = o.where("o_orderpriority <> '3-MEDIUM'").select((F.col("o_orderkey") - F.when(F.col("o_orderkey") % 100 == 7, 1).otherwise(0)).cast("string").alias("item_id"), decision.alias("decision"), F.when(F.col("o_orderkey") % 20 > 4, "motivo").otherwise(" ").alias("reason"), F.when(F.col("o_orderkey") % 50 == 1, "x").otherwise("1,5").alias("minutes"))
    return items, sheet


@query("""WITH s AS (SELECT CAST(o_orderkey - CASE WHEN o_orderkey % 100 = 7 THEN 1 ELSE 0 END AS VARCHAR) AS item_id, count(*) AS n FROM orders WHERE o_orderpriority <> '3-MEDIUM' GROUP BY 1)
SELECT 'item_duplicado' AS problem, count(*) AS n FROM s WHERE n > 1
UNION ALL SELECT 'item_nao_revisado', count(*) FROM orders WHERE CAST(o_orderkey AS VARCHAR) NOT IN (SELECT item_id FROM s)""")
def items_review_problems(spark, d):
    items, sheet = _sheet(spark, d)
    found = I.review_problems(sheet, items).where("problem in ('item_duplicado', 'item_nao_revisado')")
    return found.groupBy("problem").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority AS region, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS n_rejected, CAST(sum(CASE WHEN o_orderkey % 2 = 0 THEN 1.5 ELSE 2.0 END) AS DOUBLE) AS minutes, count(*) FILTER (o_orderstatus = 'O') / count(*) AS rejection_rate FROM orders GROUP BY 1")
def items_review_rates(spark, d):
    o = table(spark, d, "orders")
    items = o.select(F.col("o_orderkey").cast("string").alias("item_id"), F.col("o_orderpriority").alias("region"))
    sheet = o.select(F.col("o_orderkey").cast("string").alias("item_id"), F.when(F.col("o_orderstatus") == "O", "rejected").otherwise("accepted").alias("decision"), F.lit("motivo").alias("reason"), F.when(F.col("o_orderkey") % 2 == 0, "1,5").otherwise("2.0").alias("minutes"))
    return I.review_rates(I.reviewed(items, sheet), ["region"])


@query("SELECT CASE WHEN quality <> 1 THEN 'filtro:discarded' WHEN toxic = 1 THEN 'revisao:rejected' ELSE 'kept' END AS reason, count(*) AS n FROM labels GROUP BY 1")
def items_eligible_ledger(spark, d):
    rows = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "kept").otherwise("discarded").alias("filter_status"), F.when(F.col("toxic") == 1, "rejected").otherwise("accepted").alias("review_status"))
    return ledger(R.eligible(rows))


_WIDE = ", ".join(f"a[{i + 1}].text AS alternative_{x}, a[{i + 1}].is_correct AS is_correct_{x}, a[{i + 1}].source_window_id AS source_window_id_{x}" for i, x in enumerate("ABCD"))


@query(f"WITH {_SOUND} SELECT w || '__i01' AS item_id, w AS window_id, 's' AS speaker_code, 'NE' AS region, 'Qual?' AS question, {_WIDE}, CAST(NULL AS VARCHAR) AS generator_model, CAST(NULL AS VARCHAR) AS prompt_version, 'kept' AS filter_status, CAST(NULL AS VARCHAR) AS filter_reason, '' AS decision, '' AS reason, '' AS minutes FROM v")
def items_review_sheet(spark, d):
    made = I.validated(_generated(spark, d), 1).where("reason is null").withColumns({"filter_status": F.lit("kept"), "speaker_code": F.lit("s"), "region": F.lit("NE")})
    return I.review_sheet(made)


# ---- evaluation

def _tasks(spark, d, spread=False):
    option = lambda k: F.struct(F.lit("ABCD"[k]).alias("label"), F.concat(F.lit(f"opção {k} de "), F.col("o_orderkey").cast("string")).alias("text"), F.lit(k == 0).alias("is_correct"))
    items = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("item_id"), (F.col("o_orderkey") % 1000).cast("string").alias("window_id"), F.lit("Qual?").alias("question"), F.array(*[option(k) for k in range(4)]).alias("alternatives"))
    if spread:  # prompts and answers are dear, items are small: dealt evenly before they multiply
        items = items.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "item_id")
    models = spark.createDataFrame([("m0", "text_qa"), ("m1", "text_qa"), ("v0", "audio_qa")], "model_key string, role string")
    both = F.explode(F.array(F.lit("asr"), F.lit("reference"))).alias("condition")
    inputs = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("window_id"), both, "p_name", "p_size")
    inputs = inputs.withColumn("content", F.when((F.col("condition") == "asr") | (F.col("p_size") > 15), F.col("p_name")))  # small parts have no reference
    inputs = inputs.withColumn("asr_hash", F.when(F.col("condition") == "asr", F.sha2("content", 256)))
    return R.tasks(items, ["asr", "reference", "audio"], models, inputs, SEED)


_TASKS = """w AS (SELECT CAST(p_partkey AS VARCHAR) AS window_id, p_name, p_size > 15 AS ref FROM part),
c AS (SELECT * FROM (VALUES ('asr', 'm0', 0), ('asr', 'm1', 0), ('reference', 'm0', 1), ('reference', 'm1', 1), ('audio', 'v0', 2)) v(condition, model_key, condition_order)),
t AS (SELECT CAST(o_orderkey AS VARCHAR) AS item_id, condition, model_key, condition_order, CASE WHEN condition = 'asr' OR condition = 'reference' AND ref THEN p_name END AS content
  FROM orders CROSS JOIN c LEFT JOIN w ON w.window_id = CAST(o_orderkey % 1000 AS VARCHAR))"""


@query(f"WITH {_TASKS} SELECT condition, model_key, count(*) AS n, count(*) FILTER (content IS NULL) AS n_errors FROM t GROUP BY ALL")
def run_tasks(spark, d):
    return _tasks(spark, d).groupBy("condition", "model_key").agg(F.count("*").alias("n"), F.count("error").alias("n_errors"))


@query(f"WITH {_TASKS} SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY condition_order, model_key) - 1 AS ordinal, condition, model_key FROM t")
def run_ordered(spark, d):
    """Tasks in the order of emission."""
    return Q.in_order(_tasks(spark, d)).select("item_id", F.col("ordinal").cast("long").alias("ordinal"), "condition", "model_key")


def _swapped(i: int) -> str:
    return f"list_transform(range(0, 4), lambda k: CASE WHEN k = {i} THEN o[j{i} + 1] WHEN k = j{i} THEN o[{i} + 1] ELSE o[k + 1] END)"


_SHOWN = f"""h AS (SELECT *, sha256(sha256('{{{{"item_id":"' || item_id || '","model_key":"' || model_key || '","seed":{SEED}}}}}') || ':0') AS s FROM t WHERE content IS NOT NULL),
j AS (SELECT *, CAST('0x' || substr(s, 25, 8) AS BIGINT) % 4 AS j3, CAST('0x' || substr(s, 17, 8) AS BIGINT) % 3 AS j2, CAST('0x' || substr(s, 9, 8) AS BIGINT) % 2 AS j1 FROM h),
a AS (SELECT *, [0, 1, 2, 3] AS o FROM j), b AS (SELECT * EXCLUDE o, {_swapped(3)} AS o FROM a), e AS (SELECT * EXCLUDE o, {_swapped(2)} AS o FROM b), p AS (SELECT * EXCLUDE o, {_swapped(1)} AS o FROM e),
q AS (SELECT *, list_position(o, 0) - 1 AS correct, 'Responda à questão de múltipla escolha.' || chr(10) || 'TRANSCRIÇÃO DA FALA' || chr(10) || content || chr(10) || 'PERGUNTA' || chr(10) || 'Qual?' || chr(10) || 'ALTERNATIVAS' || chr(10)
  || array_to_string(list_transform(range(1, 5), lambda i: chr(64 + CAST(i AS INTEGER)) || ') opção ' || o[i] || ' de ' || item_id), chr(10)) || chr(10) || 'Responda apenas com a letra: A, B, C ou D.' AS prompt FROM p),
f AS (SELECT condition, model_key, CAST(CAST('0x' || substr(sha256('3:' || prompt), 1, 16) AS UBIGINT) % 4 AS BIGINT) = correct AS ok FROM q),
n AS (SELECT condition, model_key, count(*) AS n, count(*) FILTER (content IS NULL) AS n_errors FROM t GROUP BY ALL)""".replace("{{", "{").replace("}}", "}")


@query(f"""WITH {_TASKS}, {_SHOWN} SELECT n.model_key, n.condition, n.n, n.n_errors, CAST(0 AS BIGINT) AS n_unparsed, count(*) FILTER (f.ok) AS n_correct,
CASE WHEN n.n > n.n_errors THEN 0.0 END AS unparsed_rate, CASE WHEN n.n > n.n_errors THEN count(*) FILTER (f.ok) / (n.n - n.n_errors) END AS accuracy
FROM n LEFT JOIN f ON f.condition = n.condition AND f.model_key = n.model_key GROUP BY n.model_key, n.condition, n.n, n.n_errors""")
def run_evaluation(spark, d):
    """Tasks, answered by a deterministic stand-in, scored and tallied."""
    t = _tasks(spark, d, True).withColumn("raw_text", F.when(F.col("error").isNull(), R.fake_answer(F.col("prompt"), 3)))
    return R.cell_stats(R.scored(t))


_ASR = Q.Spec("asr0", "asr", Q.FAKE, "fake-asr", "1")


def _hypotheses(spark, d):
    """Suppliers' windows transcribed; those of negative balance are cached, those of nation 3 have no audio."""
    s = table(spark, d, "supplier")
    windows = s.select(F.col("s_suppkey").cast("string").alias("window_id"), F.when(F.col("s_nationkey") != 3, F.col("s_name")).alias("audio"))
    keyed = Q.asr_tasks(windows, _ASR).join(s.select(F.col("s_suppkey").cast("string").alias("window_id"), "s_acctbal"), "window_id")
    cache = keyed.where("s_acctbal < 0").select("key", F.concat(F.lit("cached "), "window_id").alias("text"))
    return Q.resolve(windows, _ASR, cache, Q.fake_transcript(F.col("audio"), 5))


@query("""WITH s AS (SELECT CAST(s_suppkey AS VARCHAR) AS window_id, CASE WHEN s_nationkey <> 3 THEN s_name END AS audio, s_acctbal < 0 AS cached FROM supplier),
x AS (SELECT window_id, cached, CASE WHEN cached THEN 'cached ' || window_id WHEN audio IS NOT NULL THEN 'transcrição ' || substr(sha256('5:' || audio), 1, 12) END AS content, CASE WHEN NOT cached AND audio IS NULL THEN 'insumo_ausente: window_id=' || window_id END AS input_error FROM s)
SELECT window_id, 'asr' AS condition, content, sha256(content) AS asr_hash, input_error FROM x""")
def run_asr_inputs(spark, d):
    """The recognition phase: hypotheses from the cache or the stand-in, as inputs of the answers' phase."""
    return Q.as_inputs(_hypotheses(spark, d))


@query("SELECT s_acctbal < 0 AS cached, count(*) AS n, count(*) FILTER (s_acctbal >= 0 AND s_nationkey = 3) AS n_errors FROM supplier GROUP BY 1")
def run_asr_tally(spark, d):
    return _hypotheses(spark, d).groupBy("cached").agg(F.count("*").alias("n"), F.count("error").alias("n_errors"))


def _cache(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.sha2(F.col("o_orderkey").cast("string"), 256).alias("cache_key"), "o_orderkey"), o.where("o_orderstatus = 'F'").select(F.sha2(F.col("o_orderkey").cast("string"), 256).alias("cache_key"), F.col("o_orderpriority").alias("raw_text"))


@query("SELECT sha256(CAST(o_orderkey AS VARCHAR)) AS cache_key, o_orderkey, o_orderpriority AS raw_text FROM orders WHERE o_orderstatus = 'F'")
def run_cache_hits(spark, d):
    return R.split_by_cache(*_cache(spark, d))[0]


@query("SELECT sha256(CAST(o_orderkey AS VARCHAR)) AS cache_key, o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def run_cache_pending(spark, d):
    return R.split_by_cache(*_cache(spark, d))[1]


@query("""WITH r AS (SELECT l_returnflag AS model_key, l_linestatus AS condition, l_quantity > 48 AS e, l_quantity > 40 AS u, l_quantity < 20 AS ok FROM lineitem)
SELECT model_key, condition, count(*) AS n, count(*) FILTER (e) AS n_errors, count(*) FILTER (u AND NOT e) AS n_unparsed, count(*) FILTER (ok) AS n_correct, count(*) FILTER (u AND NOT e) / count(*) FILTER (NOT e) AS unparsed_rate, count(*) FILTER (ok) / count(*) FILTER (NOT u) AS accuracy FROM r GROUP BY ALL""")
def run_cell_stats(spark, d):
    q = F.col("l_quantity")
    r = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("model_key"), F.col("l_linestatus").alias("condition"), F.when(q > 48, "asr_falhou: x").alias("error"), F.when(q <= 40, "A").alias("parsed_label"), F.when(q <= 40, q < 20).alias("is_correct"))
    return R.cell_stats(r)


@query("SELECT CASE WHEN l_quantity > 49 THEN 'asr_falhou' ELSE 'insumo_ausente' END AS kind, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY 1")
def run_errors_by_prefix(spark, d):
    q = F.col("l_quantity")
    return R.errors_by_prefix(table(spark, d, "lineitem").select(F.when(q > 49, F.concat(F.lit("asr_falhou: "), q.cast("string"))).when(q > 45, F.lit("insumo_ausente: asr")).alias("error")))


# ---- analysis

@query(f"WITH {TRIALS} SELECT coalesce(drop_reason, 'kept') AS reason, count(*) AS n FROM tagged GROUP BY 1")
def analysis_trial_ledger(spark, d):
    return ledger(S.trials(records(spark, d), speakers(spark, d)))


@query(f"WITH {TRIALS}, b AS (SELECT model_key, item_id FROM trials GROUP BY ALL HAVING count(DISTINCT condition) = 2) SELECT t.model_key, t.item_id, t.condition, t.is_correct FROM trials t SEMI JOIN b ON b.model_key = t.model_key AND b.item_id = t.item_id")
def analysis_paired(spark, d):
    return S.paired(_trials(spark, d)).select("model_key", "item_id", "condition", "is_correct")


_DRAWS = f"""ranked AS (SELECT speaker_code, region, row_number() OVER (PARTITION BY region ORDER BY speaker_code) - 1 AS r, count(*) OVER (PARTITION BY region) AS m FROM (SELECT DISTINCT speaker_code, region FROM trials)),
drawn AS (SELECT b, region, CAST('0x' || substr(sha256('{SEED}:' || b || ':' || region || ':' || r), 1, 8) AS BIGINT) % m AS r FROM ranked CROSS JOIN (SELECT unnest(range({DRAWS})) AS b)),
draws AS (SELECT b, speaker_code, d.region, count(*) AS weight FROM drawn d JOIN ranked k ON k.region = d.region AND k.r = d.r GROUP BY ALL)"""


def _draws(spark, d):
    return S.hashed_resamples(_trials(spark, d), DRAWS, SEED)


@query(f"WITH {TRIALS}, {_DRAWS} SELECT CAST(b AS INTEGER) AS b, speaker_code, region, weight FROM draws")
def analysis_resamples(spark, d):
    return _draws(spark, d)


@query(f"WITH {TRIALS}, {_DRAWS} SELECT CAST(b AS INTEGER) AS b, region, CAST(sum(weight) AS BIGINT) AS n FROM draws GROUP BY ALL")
def analysis_stratum_sizes(spark, d):
    return S.stratum_sizes(_draws(spark, d))


@query(f"""WITH {TRIALS}, {_DRAWS}, s AS (SELECT model_key, condition, speaker_code, sum(CAST(is_correct AS BIGINT)) AS k, count(*) AS n FROM trials GROUP BY ALL),
a AS (SELECT model_key, condition, b, sum(k * weight) / sum(n * weight) AS accuracy FROM s JOIN draws USING (speaker_code) GROUP BY ALL)
SELECT model_key, condition, round(quantile_cont(accuracy, 0.025), 9) AS ci_low, round(quantile_cont(accuracy, 0.975), 9) AS ci_high FROM a GROUP BY ALL""")
def analysis_bootstrap_means(spark, d):
    out = S.bootstrap_means(S.by_speaker(_trials(spark, d)), _draws(spark, d), S.CELL)
    low, high = S.interval(F.col("accuracy"))
    return out.groupBy(*S.CELL).agg(low, high).withColumns({"ci_low": F.round("ci_low", 9), "ci_high": F.round("ci_high", 9)})


@query(f"""WITH {TRIALS}, {_DRAWS}, p AS (SELECT model_key, item_id FROM trials GROUP BY ALL HAVING count(DISTINCT condition) = 2),
o AS (SELECT t.* FROM trials t SEMI JOIN p ON p.model_key = t.model_key AND p.item_id = t.item_id), c AS (SELECT *, 'geral' AS scope FROM o UNION ALL SELECT *, region FROM o),
s AS (SELECT model_key, scope, speaker_code, count(*) FILTER (condition = 'asr' AND is_correct) AS ka, count(*) FILTER (condition = 'asr') AS na, count(*) FILTER (condition <> 'asr' AND is_correct) AS kr, count(*) FILTER (condition <> 'asr') AS nr FROM c GROUP BY ALL),
e AS (SELECT model_key, scope, b, sum(ka * weight) / sum(na * weight) AS a, sum(kr * weight) / sum(nr * weight) AS r FROM s JOIN draws USING (speaker_code) GROUP BY ALL),
q AS (SELECT model_key, scope, sum(ka) / sum(na) AS a, sum(kr) / sum(nr) AS r FROM s GROUP BY ALL)
SELECT model_key, scope, round(any_value(q.a), 9) AS accuracy_asr, round(any_value(q.r), 9) AS accuracy_reference, round(any_value(q.r - q.a), 9) AS delta_asr, round(any_value(1 - q.r), 9) AS delta_reasoning, round(quantile_cont(e.r - e.a, 0.025), 9) AS asr_low, round(quantile_cont(e.r - e.a, 0.975), 9) AS asr_high,
round(quantile_cont(1 - e.r, 0.025), 9) AS reasoning_low, round(quantile_cont(1 - e.r, 0.975), 9) AS reasoning_high, CAST(0 AS BIGINT) AS n_failed FROM e JOIN q USING (model_key, scope) GROUP BY ALL""")
def analysis_decomposition(spark, d):
    out = S.decomposition(_trials(spark, d), _draws(spark, d))
    return out.withColumns({c: F.round(c, 9) for c in out.columns if c not in ("model_key", "scope", "n_failed")})


@query()
def analysis_gap_table(spark, d):
    rows = _trials(spark, d)
    return S.gap_table(rows, S.hashed_resamples(rows, RESAMPLES, SEED))


@query(f"""WITH {TRIALS} SELECT model_key, condition, sum(CAST(is_correct AS BIGINT)) FILTER (region = 'NE') / count(*) FILTER (region = 'NE') AS "accuracy_NE", sum(CAST(is_correct AS BIGINT)) FILTER (region = 'SE') / count(*) FILTER (region = 'SE') AS "accuracy_SE",
count(*) AS n_trials, count(DISTINCT speaker_code) AS n_speakers, round(sum(CAST(is_correct AS BIGINT)) FILTER (region = 'NE') / count(*) FILTER (region = 'NE') - sum(CAST(is_correct AS BIGINT)) FILTER (region = 'SE') / count(*) FILTER (region = 'SE'), 9) AS raw_gap FROM trials GROUP BY ALL""")
def analysis_raw_gaps(spark, d):
    return S.raw_gaps(_trials(spark, d)).withColumn("raw_gap", F.round("raw_gap", 9))


@query()
def analysis_sensitivity(spark, d):
    rows = _trials(spark, d)
    return S.sensitivity(rows, S.hashed_resamples(rows, RESAMPLES, SEED), SEED, (3, 8), (0, 30, 60))


@query(f"WITH {RECORDS}, i AS (SELECT speaker_code, count(DISTINCT item_id) AS n FROM records GROUP BY 1) SELECT count(*) FILTER (n < 30) AS n_short, count(*) AS n_speakers FROM i")
def analysis_short_speakers(spark, d):
    return S.short_speakers(records(spark, d), 30)


@query(f"WITH {RECORDS} SELECT count(*) FILTER (window_duration_s < 30 OR window_duration_s > 50) AS n_uncovered, count(*) AS n_trials FROM records")
def analysis_uncovered(spark, d):
    return S.uncovered(records(spark, d), (30, 40, 50))


@query(f"""WITH {RECORDS}, p AS (SELECT DISTINCT speaker_code, item_id FROM records), c AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY speaker_code ORDER BY sha256('{SEED}:' || speaker_code || ':' || item_id)) <= 3)
SELECT speaker_code, item_id, count(*) AS n FROM records SEMI JOIN c USING (speaker_code, item_id) GROUP BY ALL""")
def analysis_subsample(spark, d):
    return S.subsample_items(records(spark, d), 3, SEED).groupBy("speaker_code", "item_id").agg(F.count("*").alias("n"))


@query(f"WITH {RECORDS} SELECT CASE WHEN window_duration_s >= 30 AND window_duration_s < 40 THEN '[30, 40)' WHEN window_duration_s >= 40 AND window_duration_s < 50 THEN '[40, 50)' WHEN window_duration_s >= 50 AND window_duration_s <= 60 THEN '[50, 60]' END AS bin, count(*) AS n FROM records GROUP BY 1")
def analysis_duration_bins(spark, d):
    return records(spark, d).groupBy(S.duration_bin(F.col("window_duration_s"), (30, 40, 50, 60)).alias("bin")).agg(F.count("*").alias("n"))


# ---- sources

@query()
def source_footprint(spark, d):
    """Bytes that a projection without html reads and avoids."""
    out = footprint(spark, f"{d}/pages.parquet", ["html"])
    return out.groupBy("is_read").agg(F.sum(F.col("high") - F.col("low")).alias("bytes"), F.count_distinct("column").alias("n_columns"))


def _fetch_plan(spark, d):
    index = index_shards(spark, f"{d}/pages.parquet", "page_id")
    wanted = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("page_id"))
    return index, A.fetch_plan(index, wanted, "page_id")


@query("SELECT CAST(page_id AS VARCHAR) AS page_id, sha256(html) AS sha, CAST(strlen(html) AS BIGINT) AS n_bytes FROM pages WHERE page_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def source_selective_fetch(spark, d):
    """Blobs of the wanted keys, by row groups that hold one."""
    _, planned = _fetch_plan(spark, d)
    return fetch(planned, "page_id", "html").select("page_id", F.sha2("html", 256).alias("sha"), F.length("html").cast("long").alias("n_bytes"))


@query("SELECT CAST(count(*) AS BIGINT) AS n_wanted FROM pages WHERE page_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def source_fetch_plan(spark, d):
    """Keys that the plan reads, over all row groups."""
    index, planned = _fetch_plan(spark, d)
    return planned.agg(F.coalesce(F.sum("n_wanted"), F.lit(0)).cast("long").alias("n_wanted"))
