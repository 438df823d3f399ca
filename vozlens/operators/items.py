"""Question items: context choice, prompts, validation of generated items, the text-only filter, human review."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.answers import LABELS, extract_label
from ..functions.hashing import derived_generator
from ..functions.statistics import ratio

# Statuses and the reasons for dropping generated items, in report order.
GENERATION_REASONS = ("erro_do_modelo", "resposta_vazia", "resposta_nao_e_json", "envelope_json_invalido", "item_faltando_na_resposta", "pergunta_vazia", "n_alternativas_incorreto", "corretas_diferente_de_uma", "alternativa_vazia", "alternativas_duplicadas", "distrator_sem_proveniencia", "proveniencia_desconhecida", "sem_janelas_de_contexto")
ANSWERABLE, KEPT, DISCARDED = "respondivel_sem_audio_nem_transcricao", "kept", "discarded"
ACCEPTED, REJECTED = "accepted", "rejected"
ITEM_SCHEMA = "window_id string, index int, reason string, question string, alternatives array<struct<label: string, text: string, is_correct: boolean, source_window_id: string>>"


def context_windows(windows: DataFrame, n: int, seed: int, numpy_draws: bool = False) -> DataFrame:
    """(window_id, context): up to n other windows of the same speaker, without replacement, sorted by id.

    By smallest SHA-256 of (seed, target, other), or by a PCG64 generator a target. A
    speaker's windows are few (the target of the choice of windows), so each speaker is one
    row with the ids, which is all that is shuffled: pairs are made in the tasks and never leave them.
    """
    # a window without a speaker has no others: each is a group of its own
    alone = F.when(F.col("speaker_code").isNull(), F.col("window_id"))
    own = windows.select("speaker_code", "window_id", alone.alias("alone")).groupBy("speaker_code", "alone").agg(F.collect_list(F.struct("window_id")).alias("all"))
    ids = F.array_distinct(F.transform("all", lambda x: x["window_id"]))
    pools = own.select(F.when(F.col("speaker_code").isNotNull(), ids).alias("ids"), F.explode("all").alias("w")).select("ids", "w.window_id")
    others = F.coalesce(F.filter("ids", lambda o: o != F.col("window_id")), F.array().cast("array<string>"))
    if numpy_draws:

        @F.pandas_udf("array<string>")
        def pick(target: pd.Series, pools: pd.Series) -> pd.Series:
            def one(t: str, p: Sequence[str]) -> list[str]:
                if not len(p):
                    return []
                chosen = derived_generator(seed, "context", t).choice(len(p), size=min(n, len(p)), replace=False)
                return sorted(p[int(i)] for i in chosen)

            return pd.Series([one(t, p) for t, p in zip(target, pools, strict=True)])

        return pools.select("window_id", F.array_sort(others).alias("pool")).select("window_id", pick("window_id", "pool").alias("context"))
    keyed = F.transform(others, lambda o: F.struct(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("window_id"), o), 256).alias("key"), o.alias("id")))
    first = F.slice(F.sort_array(keyed), 1, n)
    return pools.select("window_id", F.sort_array(F.transform(first, lambda x: x["id"])).alias("context"))


def pilot_speakers(windows: DataFrame, n: int, regions: Sequence[str], low: int, high: int, seed: int, numpy_draws: bool = False) -> DataFrame:
    """(region, speaker_code, available): n speakers of each region without replacement among those of the closed age range."""
    pool = windows.where(F.col("region").isin(list(regions)) & F.col("age").between(low, high)).select("region", "speaker_code").distinct()
    sizes = pool.groupBy("region").agg(F.count("*").alias("available"))
    if numpy_draws:

        def draw(group: pd.DataFrame) -> pd.DataFrame:
            codes = sorted(group["speaker_code"])
            region = group["region"].iloc[0]
            chosen = derived_generator(seed, "pilot", region).choice(len(codes), size=min(n, len(codes)), replace=False)
            return pd.DataFrame({"region": region, "speaker_code": [codes[int(i)] for i in chosen]})

        picked = pool.groupBy("region").applyInPandas(draw, pool.schema)
    else:
        order = Window.partitionBy("region").orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), "region", F.col("speaker_code").cast("string")), 256))
        picked = pool.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n).drop("r")
    return picked.join(sizes, "region")


def generation_prompt(target: Column, contexts: Column, n_items: int, n_alternatives: int) -> Column:
    """Role, task, rules, target transcript, context excerpts and answer format, as one text."""
    head = [
        "Você elabora questões de compreensão oral a partir de transcrições.",
        "TAREFA",
        f"Escreva {n_items} questões com {n_alternatives} alternativas, uma só correta.",
        "REGRAS",
        "1. A resposta correta vem da transcrição-alvo.",
        "2. Os distratores vêm dos trechos de contexto.",
        "3. Cada alternativa cita a janela de onde veio.",
        "4. Não repita alternativas.",
        "5. Não use conhecimento externo.",
        "6. Responda apenas em JSON.",
        "TRANSCRIÇÃO-ALVO",
    ]
    shown = F.array_join(F.transform(contexts, lambda c: F.concat(F.lit("["), c["window_id"], F.lit("] "), c["text"])), "\n")
    tail = ["FORMATO DA RESPOSTA", '{"items":[{"question":"","alternatives":[{"text":"","is_correct":false,"source_window_id":""}]}]}']
    return F.concat_ws("\n", *[F.lit(x) for x in head], target, F.lit("TRECHOS DE CONTEXTO"), shown, *[F.lit(x) for x in tail])


def answer_prompt(question: Column, alternatives: Column, transcript: Column, has_audio: Column) -> Column:
    """Instruction, transcript or audio or a notice that there is neither, question, lettered alternatives, closing."""
    source = F.when(transcript.isNotNull(), F.concat(F.lit("TRANSCRIÇÃO DA FALA\n"), transcript)).when(has_audio, F.lit("ÁUDIO\nOuça o áudio anexo.")).otherwise(F.lit("CONTEXTO\nNão há áudio nem transcrição."))
    options = F.array_join(F.transform(alternatives, lambda a: F.concat(a["label"], F.lit(") "), a["text"])), "\n")
    names = F.transform(alternatives, lambda a: a["label"])
    n = F.size(names)
    listed = F.concat(F.array_join(F.slice(names, F.lit(1), n - 1), ", "), F.lit(" ou "), F.element_at(names, -1))
    return F.concat_ws("\n", F.lit("Responda à questão de múltipla escolha."), source, F.concat(F.lit("PERGUNTA\n"), question), F.concat(F.lit("ALTERNATIVAS\n"), options), F.concat(F.lit("Responda apenas com a letra: "), listed, F.lit(".")))


def envelope_py(raw: str | None) -> tuple[list | None, str | None]:
    """The list of items in a generator's answer, or the reason why there is none; a code fence is tolerated."""
    text = (raw or "").strip()
    if not text:
        return None, "resposta_vazia"
    if text.startswith("```"):
        lines = text.splitlines()[1:]
        while lines and lines[-1].strip().startswith("```"):
            lines.pop()
        text = "\n".join(lines).strip()
    try:
        found = json.loads(text)
    except ValueError:
        return None, "resposta_nao_e_json"
    if not isinstance(found, dict) or not isinstance(found.get("items"), list):
        return None, "envelope_json_invalido"
    return found["items"], None


def item_reason_py(item: Any, n_alternatives: int, target: str, allowed: set[str], provenance: bool) -> str | None:
    """The first rule that an item breaks: shape, question, alternatives, one correct, duplicates, provenance."""
    if not isinstance(item, dict):
        return "envelope_json_invalido"
    question, options = item.get("question"), item.get("alternatives")
    if not (isinstance(question, str) and question.strip()):
        return "pergunta_vazia"
    if not isinstance(options, list) or len(options) != n_alternatives:
        return "n_alternativas_incorreto"
    for o in options:
        if not isinstance(o, dict):
            return "envelope_json_invalido"
        if not (isinstance(o.get("text"), str) and o["text"].strip()):
            return "alternativa_vazia"
        if not isinstance(o.get("source_window_id"), str | None):
            return "envelope_json_invalido"
    right = [bool(o.get("is_correct", False)) for o in options]
    if sum(right) != 1:
        return "corretas_diferente_de_uma"
    if len({o["text"].strip().casefold() for o in options}) < len(options):
        return "alternativas_duplicadas"
    if provenance:
        for o, correct in zip(options, right, strict=True):
            source = (o.get("source_window_id") or "").strip()
            if not source:
                return "distrator_sem_proveniencia"
            if source not in ({target} if correct else allowed):
                return "proveniencia_desconhecida"
    return None


def validated(answers: DataFrame, n_items: int, n_alternatives: int = 4, provenance: bool = True) -> DataFrame:
    """One row for each of the n_items asked of a window: the item, or the reason why it is dropped.

    ``answers`` has window_id, context (array of ids) and raw_text. JSON's looseness
    (truthy flags, order of checks) decides the reasons, so rows go through Python in Arrow batches.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for window, context, raw in zip(frame["window_id"], frame["context"], frame["raw_text"], strict=True):
                allowed = set(context) if context is not None else set()
                if provenance and not allowed:
                    out += [(window, i, "sem_janelas_de_contexto", None, None) for i in range(n_items)]
                    continue
                found, reason = envelope_py(raw)
                for i in range(n_items):
                    why = reason or ("item_faltando_na_resposta" if i >= len(found) else item_reason_py(found[i], n_alternatives, window, allowed, provenance))
                    if why:
                        out.append((window, i, why, None, None))
                    else:
                        options = [{"label": LABELS[k], "text": o["text"].strip(), "is_correct": bool(o.get("is_correct", False)), "source_window_id": (o.get("source_window_id") or "").strip() or None} for k, o in enumerate(found[i]["alternatives"])]
                        out.append((window, i, None, found[i]["question"].strip(), options))
            yield pd.DataFrame(out, columns=["window_id", "index", "reason", "question", "alternatives"])

    made = answers.select("window_id", "context", "raw_text").mapInPandas(run, ITEM_SCHEMA)
    return made.withColumn("item_id", F.when(F.col("reason").isNull(), F.format_string("%s__i%02d", "window_id", F.col("index") + 1)))


def filter_runs(answers: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """Adds parsed and is_correct to (…, raw_text, correct_label); an unparsed answer counts as not correct here."""
    parsed = answers.withColumn("parsed", extract_label(F.col("raw_text"), labels))
    return parsed.withColumn("is_correct", F.coalesce(F.col("parsed") == F.col("correct_label"), F.lit(False)))


def filter_decisions(runs: DataFrame, at_least: int = 2, any_model: bool = True) -> DataFrame:
    """Per item: discarded when any (or every) model is right in ``at_least`` runs without audio or transcript."""
    by_model = runs.groupBy("item_id", "model_key").agg(F.count_if("is_correct").alias("n_correct"), F.count_if(F.col("parsed").isNull()).alias("n_unparsed"), F.count("*").alias("n_runs"))
    hit = F.col("n_correct") >= at_least
    trigger = F.array_sort(F.collect_list(F.when(hit, F.concat("model_key", F.lit("="), F.col("n_correct").cast("string"), F.lit("/"), F.col("n_runs").cast("string")))))
    out = by_model.groupBy("item_id").agg(F.count_if(hit).alias("n_triggering"), F.count("*").alias("n_models"), trigger.alias("triggers"), F.sum("n_unparsed").alias("n_unparsed"))
    discard = F.col("n_triggering") > 0 if any_model else F.col("n_triggering") == F.col("n_models")
    reason = F.when(discard, F.concat(F.lit(ANSWERABLE + ": "), F.array_join("triggers", ", ")))
    return out.select("item_id", F.when(discard, DISCARDED).otherwise(KEPT).alias("filter_status"), reason.alias("filter_reason"), "n_triggering", "n_unparsed")


def discard_rates(decisions: DataFrame, keys: Sequence[str]) -> DataFrame:
    out = decisions.groupBy(*keys).agg(F.count("*").alias("n_items"), F.count_if(F.col("filter_status") == DISCARDED).alias("n_discarded"))
    return out.withColumn("discard_rate", ratio(F.col("n_discarded"), F.col("n_items")))


def sheet_columns(n_alternatives: int) -> list[str]:
    """The columns of a review sheet."""
    head = ["item_id", "window_id", "speaker_code", "region", "question"]
    each = [f"{part}_{label}" for label in LABELS[:n_alternatives] for part in ("alternative", "is_correct", "source_window_id")]
    return head + each + ["generator_model", "prompt_version", "filter_status", "filter_reason", "decision", "reason", "minutes"]


def review_sheet(items: DataFrame, n_alternatives: int = 4, only_kept: bool = True) -> DataFrame:
    """Items in wide form for human review, by item_id; alternatives become columns."""
    rows = items.where(F.col("filter_status") == KEPT) if only_kept else items
    wide = [F.get("alternatives", i)[source].alias(f"{part}_{label}") for i, label in enumerate(LABELS[:n_alternatives]) for part, source in (("alternative", "text"), ("is_correct", "is_correct"), ("source_window_id", "source_window_id"))]
    blank = [F.lit("").alias(c) for c in ("decision", "reason", "minutes")]
    named = [F.col(c) if c in items.columns else F.lit(None).cast("string").alias(c) for c in ("item_id", "window_id", "speaker_code", "region", "question")]
    tail = [F.col(c) if c in items.columns else F.lit(None).cast("string").alias(c) for c in ("generator_model", "prompt_version", "filter_status", "filter_reason")]
    return rows.select(*named, *wide, *tail, *blank).orderBy("item_id")


def minutes(raw: Column) -> Column:
    """A decimal with comma or dot; null where it isn't one."""
    return F.expr("try_cast(NULL as double)") if raw is None else F.trim(F.replace(raw, F.lit(","), F.lit("."))).try_cast("double")


def review_problems(sheet: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, problem) for all that makes a sheet unusable; empty for a sound one."""
    both = sheet.groupBy("item_id").agg(F.count("*").alias("n"), F.first("decision").alias("decision"), F.first("reason").alias("reason"), F.first("minutes").alias("minutes")).alias("s").join(items.select("item_id").alias("i"), F.col("s.item_id") == F.col("i.item_id"), "full_outer")
    m = minutes(F.col("s.minutes"))
    checks = [
        (F.coalesce(F.col("s.item_id"), F.lit("")) == "", "item_nao_revisado"),
        (F.col("i.item_id").isNull(), "item_desconhecido"),
        (F.col("s.n") > 1, "item_duplicado"),
        (~F.coalesce(F.col("s.decision").isin(ACCEPTED, REJECTED), F.lit(False)), "decisao_fora_do_vocabulario"),
        (m.isNull() | (m < 0), "minutos_invalidos"),
        ((F.col("s.decision") == REJECTED) & (F.coalesce(F.trim("s.reason"), F.lit("")) == ""), "rejeicao_sem_motivo"),
    ]
    flags = F.filter(F.array(*[F.when(c, F.lit(name)) for c, name in checks]), lambda x: x.isNotNull())
    return both.select(F.coalesce("s.item_id", "i.item_id").alias("item_id"), F.explode(flags).alias("problem"))


def reviewed(items: DataFrame, sheet: DataFrame) -> DataFrame:
    """Items with review_status, review_reason and review_minutes; raises at run time on any problem row."""
    bad = review_problems(sheet, items).agg(F.count("*").alias("n"))
    rows = items.join(sheet.select("item_id", F.col("decision").alias("review_status"), F.col("reason").alias("review_reason"), minutes(F.col("minutes")).alias("review_minutes")), "item_id", "left")
    return rows.join(F.broadcast(bad)).where(F.when(F.col("n") > 0, F.raise_error(F.lit("the review sheet has problems"))).otherwise(True)).drop("n")


def review_rates(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    out = items.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("review_status") == REJECTED).alias("n_rejected"), F.sum("review_minutes").alias("minutes"))
    return out.withColumn("rejection_rate", ratio(F.col("n_rejected"), F.col("n")))
