"""Which kind of task a prompt is, by keywords; and layered configuration."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Categories from cheap to dear, the model of each, and their keywords.
CATEGORIES = ("quick_fix", "standard", "architecture", "research")
RULES = {"quick_fix": "haiku", "standard": "sonnet", "architecture": "opus", "research": "opus"}
KEYWORDS = {
    "quick_fix": "fix bug typo corrigir conserta ajustar ajuste quick rápido rapido pequeno rename renomear".split(),
    "standard": "implement implementar add adicionar feature build construir refactor refatorar criar create update atualizar".split(),
    "architecture": "architecture arquitetura design redesign migrate migração migracao sistema system scale escalar infra infraestrutura".split(),
    "research": "research pesquisar pesquisa investigate investigar analyze analisar compare comparar avaliar evaluate avaliação".split(),
}


def default_config() -> dict:
    return {"rules": dict(RULES), "keywords": {k: list(v) for k, v in KEYWORDS.items()}}


def config_from_toml(text: str) -> dict:
    """The defaults with the document's rules and keywords over them. A broken document is an error."""
    given, out = tomllib.loads(text), default_config()
    for part in ("rules", "keywords"):
        section = given.get(part, {})
        if not isinstance(section, dict):
            raise ValueError(f"{part} is no table")
        out[part] |= section
    return out


def saver_config(global_toml: str, project_toml: str | None = None) -> dict[str, dict]:
    """Savers of the global document; a project's may only turn them on or off."""
    savers = {k: dict(v) for k, v in tomllib.loads(global_toml).get("savers", {}).items()}
    for name, section in (tomllib.loads(project_toml).get("savers", {}) if project_toml else {}).items():
        if set(section) - {"enabled"}:
            raise ValueError(f"a project may only set enabled of {name}")
        if name in savers:
            savers[name]["enabled"] = bool(section.get("enabled", savers[name].get("enabled", True)))
    return savers


def suggest(prompts: DataFrame, config: dict | None = None) -> DataFrame:
    """query_id, category, model, matched: the category of highest score; none or a tie is `standard`.

    A keyword found in the prompt, wherever it stands, scores its words plus a
    twentieth of its characters. prompts: query_id, prompt. The keyword table is
    the configuration's, so prompts are scored in their own rows, without a join.
    """
    c = config or default_config()
    low = F.lower(F.coalesce("prompt", F.lit("")))
    scores, found = {}, {}
    for name in CATEGORIES:
        table = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(len(k.split()) + len(k) / 20).alias("w"), F.lit(k.lower()).alias("low")) for k in c["keywords"].get(name, []) if k)) if c["keywords"].get(name) else F.array().cast("array<struct<k:string,w:double,low:string>>")
        hit = F.filter(table, lambda x: F.contains(F.col("_low"), x["low"]))
        scores[name] = F.round(F.aggregate(hit, F.lit(0.0), lambda s, x: s + x["w"]), 9)
        found[name] = F.transform(hit, lambda x: x["k"])
    rows = prompts.withColumn("_low", low).select("query_id", *(scores[n].alias(f"s_{n}") for n in CATEGORIES), *(found[n].alias(f"m_{n}") for n in CATEGORIES))
    top = F.greatest(*(F.col(f"s_{n}") for n in CATEGORIES))
    ties = sum((F.col(f"s_{n}") == top).cast("int") for n in CATEGORIES)
    clear = (top > 0) & (ties == 1)
    category, matched = F.lit("standard"), F.array().cast("array<string>")
    for n in CATEGORIES:
        wins = clear & (F.col(f"s_{n}") == top)
        category, matched = F.when(wins, n).otherwise(category), F.when(wins, F.col(f"m_{n}")).otherwise(matched)
    model = F.lit(c["rules"].get("standard", "sonnet"))
    for n in CATEGORIES:
        model = F.when(F.col("category") == n, c["rules"].get(n, "sonnet")).otherwise(model)
    return rows.select("query_id", category.alias("category"), matched.alias("matched")).withColumn("model", model)
