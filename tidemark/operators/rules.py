"""Materiality cascade and credit guard: narrow plans of column expressions, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import lexicon as X
from tidemark.functions.text import any_match, clean, first_match

NOT_MATERIAL = "NON_MATERIAL_FINANCIAL_CONTENT"
GATES = [X.LISTING_SUPPRESS, X.PERSONAL_FINANCE_SUPPRESS, X.PERSONAL_INTENT_SUPPRESS, X.OPINION_SUPPRESS, X.BOYCOTT_SUPPRESS, X.PERSONAL_CREDIT_SUPPRESS]


def _verdict(material: str | Column, kind: str | Column, reason: str | Column) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(material).alias("materiality"), lit(kind).alias("final_type"), lit(reason).alias("reason"))


def materiality(df: DataFrame, text: str, event_type: str, relevance: str, confidence: str) -> DataFrame:
    """Adds materiality, final_type and reason.

    Per type there are two helper columns: what its first positive pattern matches, and why the type is
    suppressed.  The gates are one CASE over them.  One alternation of all positive patterns and one of all gates come
    first: most texts hold none and are done with these two."""
    t = F.col("__t")
    types = list(X.RULES)
    relevant = (F.coalesce(F.col(relevance), F.lit("")) == "FINANCIAL_EVENT") & (F.col("__t") != "")
    df = df.withColumn("__t", clean(F.col(text))).withColumn("__open", relevant)
    df = df.withColumn("__some", F.col("__open") & any_match(t, [p for name in types for p in X.RULES[name]]))
    df = df.withColumn("__gated", F.col("__open") & any_match(t, [p for patterns in GATES for p in patterns]))
    asked = F.col("__open")  # no list is tried behind the first gates
    for k, name in enumerate(types):
        sup = F.when(any_match(t, X.TYPE_SUPPRESS[name]), X.SUPPRESSED[name]) if name in X.TYPE_SUPPRESS else F.lit(None).cast("string")
        if name == "Merger & Acquisition":
            sup = F.coalesce(sup, F.when(t.rlike("(?i)^if\\b") & ~any_match(t, X.DEAL_SIGN), "conditional_framing"))
        df = df.withColumn(f"__hit{k}", F.when(F.col("__some"), first_match(t, X.RULES[name]))).withColumn(f"__sup{k}", F.when(asked & (F.col(f"__hit{k}").isNotNull() | (F.col(event_type) == name)), sup))
    weak = lambda h: (F.col(confidence) < 0.20) & (F.length(h) < 9) & ~h.rlike("\\d")
    own_hit = F.coalesce(*[F.when(F.col(event_type) == n, F.col(f"__hit{k}")) for k, n in enumerate(types)])
    own_sup = F.coalesce(*[F.when(F.col(event_type) == n, F.col(f"__sup{k}")) for k, n in enumerate(types)])
    hit = lambda n: F.col(f"__hit{types.index(n)}")
    out = F.when(F.coalesce(F.col(relevance), F.lit("")) != "FINANCIAL_EVENT", _verdict("NO_EVENT", "NO_EVENT", "relevance_gate"))
    out = out.when(t == "", _verdict(NOT_MATERIAL, "NO_EVENT", "empty_text"))
    out = out.when(F.col("__gated") & any_match(t, X.LISTING_SUPPRESS), _verdict(NOT_MATERIAL, "NO_EVENT", "consumer_listing_context"))
    out = out.when(F.col("__gated") & any_match(t, X.PERSONAL_FINANCE_SUPPRESS), _verdict(NOT_MATERIAL, "NO_EVENT", "personal_finance_context"))
    out = out.when(F.col("__gated") & any_match(t, X.PERSONAL_INTENT_SUPPRESS), _verdict(NOT_MATERIAL, "NO_EVENT", "personal_intent_statement"))
    out = out.when(F.col("__gated") & any_match(t, X.OPINION_SUPPRESS) & own_hit.isNull(), _verdict(NOT_MATERIAL, "NO_EVENT", "opinion_or_prediction_framing"))
    out = out.when(F.col("__gated") & any_match(t, X.BOYCOTT_SUPPRESS) & hit("Regulatory / Legal").isNull(), _verdict(NOT_MATERIAL, "NO_EVENT", "boycott_or_activism_framing"))
    out = out.when(F.col("__gated") & any_match(t, X.PERSONAL_CREDIT_SUPPRESS) & hit("Credit Event").isNull(), _verdict(NOT_MATERIAL, "NO_EVENT", "personal_credit_complaint"))
    out = out.when(own_sup.isNotNull(), _verdict(NOT_MATERIAL, "NO_EVENT", own_sup))
    out = out.when(own_hit.isNotNull() & ~weak(own_hit), _verdict("MATERIAL_EVENT", F.col(event_type), F.concat(F.lit("upstream_type_confirmed:"), own_hit)))
    for k, name in enumerate(types):
        h = F.col(f"__hit{k}")
        ok = (F.coalesce(F.col(event_type), F.lit("")) != name) & F.col(f"__sup{k}").isNull() & h.isNotNull() & ~weak(h)
        out = out.when(ok, _verdict("MATERIAL_EVENT", name, F.concat(F.lit(f"rescued_cross_type:{name}:"), h)))
    out = out.otherwise(_verdict(NOT_MATERIAL, "NO_EVENT", "no_sufficient_event_evidence"))
    return df.withColumn("__v", out).select(*[c for c in df.columns if not c.startswith("__")], "__v.*")


def credit_guard(df: DataFrame, text: str, entity: str, status: str, event_type: str) -> DataFrame:
    """Adds credit_guard_pass and credit_guard_reason; other event types pass as NOT_APPLICABLE."""
    t, e = F.lower(F.coalesce(F.col(text), F.lit(""))), F.lower(F.coalesce(F.col(entity), F.lit("")))
    has = lambda *words: any_match(t, [f"\\Q{w}\\E" for w in words])
    reason = (
        F.when(F.coalesce(F.col(event_type), F.lit("")) != "Credit Event", "NOT_APPLICABLE")
        .when(any_match(t, X.WEAK_CONTEXTS), "LEXICAL_COLLISION")
        .when(F.col(status) == "unresolved_source", "ENTITY_COLLISION_PUBLISHER")
        .when((e == "ford") & has(*X.GUARD_WORDS["ford"]), "ENTITY_COLLISION_PERSON")
        .when((e == "disney") & has(*X.GUARD_WORDS["disney"]), "ENTITY_COLLISION_PERSON")
        .when((e == "visa") & has(*X.GUARD_WORDS["visa"]), "ENTITY_COLLISION_CONCEPT")
        .when(~any_match(t, X.STRONG_TERMS), "MISSING_STRONG_CREDIT_EVIDENCE")
        .otherwise("PASSED")
    )
    return df.withColumn("credit_guard_reason", reason).withColumn("credit_guard_pass", F.col("credit_guard_reason").isin("NOT_APPLICABLE", "PASSED"))


def offline_guard(text: Column, entity: Column) -> Column:
    """The five classes of the offline guard; only a true credit event passes."""
    t, e = F.lower(F.coalesce(text, F.lit(""))), F.lower(F.coalesce(entity, F.lit("")))
    out = F.when(any_match(t, X.WEAK_CONTEXTS), "LEXICAL_COLLISION")
    for name, words in X.OFFLINE_WORDS.items():
        out = out.when((e == name) & any_match(t, [f"\\Q{w}\\E" for w in words]), "ENTITY_COLLISION")
    return out.when(any_match(t, X.STRONG_TERMS), "TRUE_CREDIT_EVENT").otherwise("AMBIGUOUS")


def naive_audit(text: Column, name: Column) -> Column:
    """A rough audit of credit events: any "setting" counts as lexical."""
    t = F.lower(F.coalesce(text, F.lit("")))
    lexical = (t.contains("default") & t.contains("browser")) | t.contains("setting")
    true = t.contains("credit") | t.contains("bankruptcy")
    return F.when(F.lower(name).isin(X.COLLIDING), "FALSE_POSITIVE_ENTITY_COLLISION").when(lexical, "FALSE_POSITIVE_LEXICAL").when(true, "TRUE_CREDIT_EVENT").otherwise("AMBIGUOUS")


def credit_categories(text: Column) -> Column:
    """All categories of the credit lexicon that a text shows."""
    t = clean(text)
    return F.array_compact(F.array(*[F.when(any_match(t, patterns), name) for name, patterns in X.CREDIT_AUDIT.items()]))


def credit_context(text: Column) -> Column:
    """strength of a credit text: STRONG where a company anchors it and no weak context spoils it, WEAK otherwise."""
    t = clean(text)
    return F.when(any_match(t, X.CREDIT_ANCHORS) & ~any_match(t, X.WEAK_CREDIT), "STRONG").otherwise("WEAK")
