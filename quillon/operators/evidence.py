"""Evidence: sources of an answer, budgets of a prompt, checks of citations and of lexical support."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon import runtime as rt
from quillon.functions import text as tx


@dataclass(frozen=True)
class Mode:
    sources: int
    per_source: int
    total: int
    discrepancies: int = 2


# Budgets of the two answer modes.
MODES = {"compact": Mode(4, 1300, 5600), "detailed": Mode(8, 1700, 11000, 3)}


def search_limit(mode: str) -> int:
    """Results a question's search asks for."""
    return max(18, 4 * MODES[mode].sources)


def base_sources(results: DataFrame, mode: str = "compact") -> DataFrame:
    """(answer_id, ord, section_ref): the best sections among the ranked results (answer_id, rank, id, kind) of a question, few per answer."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("answer_id").orderBy("rank"))
    best = results.where("kind = 'section'").withColumn("ord", place).where(F.col("ord") <= MODES[mode].sources)
    return best.select("answer_id", "ord", F.col("id").alias("section_ref"))


def collected(base: DataFrame, records: DataFrame, claims: DataFrame, notes: DataFrame, conflicts: DataFrame, query: str, mode: str = "compact") -> dict[str, DataFrame]:
    """What an answer to a question may rest on.

    base: see base_sources; records: search records of sections; claims (claim_ref, section_ref, text, quote); notes as
    normalised; conflicts (section_ref, counterpart) of confirmed discrepancies. Returns

    * sources (answer_id, source_no, source_id, section_ref, supplemental, title, document_title, body, claims), the other sides of
      discrepancies after the sources they differ from,
    * notes about one of the claims, or whose title or body holds the question, and conflicts, those that contradict or supersede.

    Questions have few sources, so all but the records and claims they look up is small.
    """
    refs = discrepancy_expansion(base, conflicts.join(F.broadcast(base.select("section_ref").distinct()), "section_ref", "left_semi"), MODES[mode].discrepancies)
    refs = rt.written(refs, "evidence-refs")
    wanted = F.broadcast(refs.select("section_ref").distinct())  # at most sources + discrepancies per answer
    body = records.select(F.col("id").alias("section_ref"), "title", "document_title", "body").join(wanted, "section_ref", "left_semi")
    said = rt.written(claims.join(wanted, "section_ref", "left_semi"), "evidence-claims")
    per = said.groupBy("section_ref").agg(F.count(F.lit(1)).alias("claims"))
    sources = refs.join(body, "section_ref").join(per, "section_ref", "left").select(
        "answer_id", "source_no", F.concat(F.lit("S"), "source_no").alias("source_id"), "section_ref", "supplemental", "title", "document_title", "body",
        F.coalesce("claims", F.lit(0)).alias("claims"),
    )
    holds = lambda c: F.contains(F.lower(c), F.lit(query.strip().lower()))
    about = said.select(F.element_at(F.split("claim_ref", "::"), -1).alias("claim_id")).distinct().withColumn("about", F.lit(True))
    related = notes.join(F.broadcast(about), "claim_id", "left").where(F.col("about") | holds("title") | holds("body")).drop("about")
    return {"sources": sources, "claims": said, "notes": related, "conflicts": related.where("relation in ('contradicts', 'supersedes')")}


def fragments(sources: DataFrame, claims: DataFrame) -> DataFrame:
    """(answer_id, source_id, fragment): sentences of the fields of every source and of its claims, each once by its normalised form."""
    own = sources.select("answer_id", "source_id", F.posexplode(F.array("title", "body", "document_title")).alias("at", "value"))
    said = sources.select("answer_id", "source_id", "section_ref").join(claims, "section_ref")
    said = said.select("answer_id", "source_id", F.posexplode(F.array("text", "quote")).alias("at", "value")).withColumn("at", F.col("at") + 3)
    each = own.unionByName(said).select("answer_id", "source_id", "at", F.posexplode(tx.split_statements(F.col("value"))).alias("n", "sentence"))
    clean = each.withColumn("fragment", tx.strip_markup(F.col("sentence"))).withColumn("key", tx.normalize_text(F.col("fragment"))).where("key <> ''")
    first = clean.groupBy("answer_id", "source_id", "key").agg(F.min(F.struct("at", "n", "fragment")).getField("fragment").alias("fragment"))
    return first.select("answer_id", "source_id", "fragment")


def discrepancy_block(sides: DataFrame) -> DataFrame:
    """Neutral two-sided text of discrepancies: sides (id, type, source_text, source_document, target_text, target_document)."""
    line = lambda n, s: F.concat(F.lit(f"{n}) "), tx.clip_text(F.coalesce(f"{s}_text", F.lit("")), 600), F.lit(" — "), F.coalesce(f"{s}_document", F.lit("")))
    return sides.select("id", F.concat_ws("\n", F.concat(F.lit("["), "type", F.lit("]")), line(1, "source"), line(2, "target")).alias("block"))


def citation_check(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """answers (answer_id, text), sources (answer_id, source_id) → valid and invalid citations; grounded with at least one valid and none invalid."""
    allowed = sources.groupBy("answer_id").agg(F.collect_set("source_id").alias("allowed"))  # the few sources of one answer
    cited = F.array_distinct(tx.citation_ids(F.col("text")))
    out = answers.join(allowed, "answer_id", "left").withColumn("allowed", F.coalesce("allowed", F.array().cast("array<string>")))
    out = out.select("answer_id", F.size(F.array_intersect(cited, "allowed")).alias("valid"), F.size(F.array_except(cited, F.col("allowed"))).alias("invalid"))
    return out.withColumn("grounded", (F.col("valid") > 0) & (F.col("invalid") == 0))


def fragment_support(pairs: DataFrame, composed: bool = False) -> DataFrame:
    """pairs (…, statement, fragment) with terms, matched, coverage, numbers missing, negation mismatch and the verdict."""
    if not composed:  # composed once per text; a lambda cannot hold a Python function
        pairs = pairs.withColumns({c: tx.compose(F.coalesce(F.col(c), F.lit(""))) for c in ("statement", "fragment")})
    numbers = lambda c: F.array_distinct(
        F.transform(
            F.regexp_extract_all(tx.strip_markup(F.coalesce(c, F.lit(""))), F.lit(r"(?iu)(?<![A-Za-z0-9_])\d+(?:[.,]\d+)?(?:\s*%|\s*(?:мг|мл|г|кг|см|мм|дн|дней|час|ч|лет|месяц[A-Za-z0-9_]*))?"), F.lit(0)),
            lambda n: tx.normalize_text(n, True),
        )
    )
    terms, matched = tx.coverage(F.col("statement"), F.col("fragment"), composed=True)
    out = pairs.withColumns({
        "terms": terms, "matched": matched, "missing_numbers": F.size(F.array_except(numbers(F.col("statement")), numbers(F.col("fragment")))),
        "negation_mismatch": tx.answer_negation(F.col("statement")) != tx.answer_negation(F.col("fragment")),
    })
    share = F.when(F.col("terms") > 0, F.col("matched") / F.col("terms")).otherwise(0.0)
    return out.withColumn("coverage", F.round(share, 6)).withColumn(
        "supported", (F.col("terms") > 0) & (share >= tx.support_threshold(F.col("terms"))) & (F.col("missing_numbers") == 0) & ~F.col("negation_mismatch")
    )


def verify(statements: DataFrame, fragments: DataFrame) -> DataFrame:
    """statements (answer_id, statement_no, statement), fragments (answer_id, source_id, fragment).

    Statements about the answer itself are skipped; without a citation a statement is unsupported; otherwise its best
    fragment among the cited sources decides.
    """
    own = statements.where(~tx.is_meta_statement(F.col("statement"))).withColumn("cited", F.array_distinct(tx.citation_ids(F.col("statement"))))
    each = own.select("answer_id", "statement_no", "statement", F.explode_outer("cited").alias("source_id"))
    judged = fragment_support(each.join(fragments, ["answer_id", "source_id"], "left").withColumn("fragment", F.coalesce("fragment", F.lit(""))))
    best = F.max(F.struct("coverage", -F.col("missing_numbers"), ~F.col("negation_mismatch"), "matched", "supported"))
    out = judged.groupBy("answer_id", "statement_no").agg(best.alias("b"), F.max(F.col("source_id").isNotNull()).alias("cites"))
    return out.select("answer_id", "statement_no", F.col("b.coverage").alias("coverage"), (F.col("cites") & F.col("b.supported")).alias("supported"),
                      F.when(~F.col("cites"), "missing-citation").when(F.col("b.supported"), "supported").otherwise("unsupported").alias("reason"))


def prompt_sources(sources: DataFrame, mode: str = "compact") -> DataFrame:
    """First N primary and first M supplemental sources of every answer: sources (answer_id, ord, supplemental, …)."""
    from pyspark.sql import Window

    m = MODES[mode]
    w = Window.partitionBy("answer_id", "supplemental").orderBy("ord")
    return sources.withColumn("n", F.row_number().over(w)).where(F.col("n") <= F.when(F.col("supplemental"), m.discrepancies).otherwise(m.sources)).drop("n")


def _packed(pdf: pd.DataFrame, mode: Mode) -> pd.DataFrame:
    left, rows = mode.total, []
    for r in pdf.sort_values("ord").itertuples():
        heading = len(r.heading)
        room = min(mode.per_source, left - heading)
        if room < 80:
            break
        body = r.body.strip()
        if len(body) > room:
            body = body[: room - 1].rstrip() + "…"
        rows.append((r.answer_id, int(r.ord), f"{r.heading}{body}"))
        left -= heading + len(body) + 2
    return pd.DataFrame(rows, columns=["answer_id", "ord", "block"])


def packed_prompt(sources: DataFrame, mode: str = "compact") -> DataFrame:
    """Source blocks that fit the budget, clipped, in order: sources (answer_id, ord, heading, body), few per answer."""
    m = MODES[mode]
    chosen = sources.select("answer_id", "ord", "heading", F.coalesce("body", F.lit("")).alias("body"))
    return chosen.groupBy("answer_id").applyInPandas(lambda pdf: _packed(pdf, m), "answer_id long, ord int, block string")


def _expanded(pdf: pd.DataFrame, limit: int) -> pd.DataFrame:
    """Counterparts of confirmed conflicts after their anchors, at most `limit` conflicts and `limit` added sources."""
    base = pdf[["answer_id", "ord", "section_ref"]].drop_duplicates().sort_values("ord")
    have, added, used = set(base["section_ref"]), [], 0
    for r in pdf[pdf["counterpart"].notna()].sort_values(["ord", "counterpart"]).itertuples():
        if used >= limit:
            break
        missing = [] if r.counterpart in have else [r.counterpart]
        if len(added) + len(missing) > limit:
            continue
        used += 1
        for c in missing:
            have.add(c)
            added.append((r.ord, c))
    rows, n = [], 1
    for r in base.itertuples():
        rows.append((r.answer_id, n, r.section_ref, False))
        n += 1
        for anchor, c in added:
            if anchor == r.ord:
                rows.append((r.answer_id, n, c, True))
                n += 1
    return pd.DataFrame(rows, columns=["answer_id", "source_no", "section_ref", "supplemental"])


def discrepancy_expansion(sources: DataFrame, conflicts: DataFrame, limit: int = 2) -> DataFrame:
    """sources (answer_id, ord, section_ref) with the other side of confirmed conflicts (section_ref, counterpart), renumbered."""
    both = sources.join(conflicts, "section_ref", "left").select("answer_id", "ord", "section_ref", "counterpart")
    return both.groupBy("answer_id").applyInPandas(lambda pdf: _expanded(pdf, limit), "answer_id long, source_no int, section_ref string, supplemental boolean")
