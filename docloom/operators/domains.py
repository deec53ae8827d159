"""Domains: entity types, thresholds, prompts and chunking settings, kept on the driver as small tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

THRESHOLDS = {"ADDRESS": 0.5, "CHARACTER": 0.4, "DATE": 0.6, "INSTITUTION": 0.4, "LOCATION": 0.3}
DEFAULT_THRESHOLD = 0.3


@dataclass(frozen=True)
class Domain:
    name: str
    types: tuple[str, ...]
    strategy: str = "percentile"
    percentile: float = 90.0
    cleaning: bool = False
    thresholds: dict[str, float] = field(default_factory=lambda: dict(THRESHOLDS))
    meta: str = "List what to look for among {types} in:\n{text}"
    extraction: str = "Return entities of the types {types} as JSON from:\n{text}"

    def prompt(self, text: Column, instructions: Column | None = None) -> Column:
        head = F.lit(self.extraction.split("{text}")[0].replace("{types}", ", ".join(self.types)))
        return F.concat(head, F.coalesce(instructions, F.lit("")), text) if instructions is not None else F.concat(head, text)

    def meta_prompt(self, text: Column) -> Column:
        return F.concat(F.lit(self.meta.split("{text}")[0].replace("{types}", ", ".join(self.types))), text)


_GENERAL = ("ADDRESS", "CHARACTER", "DATE", "EMOTION", "EVENT", "INSTITUTION", "LOCATION", "OBJECT", "SCENE")
_INSURANCE = (
    "ADRES ANEKS_DO_UMOWY ARTYKUŁ_PRAWNY BENEFICJENT CHOROBA CZYNNOŚĆ_FORMALNA DEFINICJA DEKLARACJA DOKUMENT INDEKSACJA "
    "KATASTROFA_NATURALNA KWOTA LIKWIDACJA_SZKODY LOKALIZACJA NUMER_BANKOWY NUMER_TELEFONU ODNIESIENIE ODSZKODOWANIE ORGANIZACJA "
    "PODMIOT_FORMALNY PODMIOT_UMOWY POLISA_UBEZPIECZENIOWA PRZEDMIOT_UBEZPIECZENIA PŁATNIK REGRES_UBEZPIECZYCIELA ROZDZIAŁ "
    "RYZYKO_UBEZPIECZENIOWE RZECZOZNAWCA SIŁA_WYŻSZA SKŁADKA_UBEZPIECZENIOWA SUMA_UBEZPIECZENIA TERMINOLOGIA TERMIN_CZASOWY "
    "TERMIN_ZDEFINIOWANY UBEZPIECZAJĄCY UBEZPIECZONY USZCZERBEK_NA_ZDROWIU WARIANT_UBEZPIECZENIA WARUNEK WYJAŚNIENIE WYPADEK "
    "WYŁĄCZENIE_Z_UMOWY ZDARZENIE ZGŁOSZENIE_SZKODY"
).split()

DOMAINS = {
    d.name: d
    for d in (
        Domain("literary", _GENERAL, percentile=92),
        Domain("simple", ("ADDRESS", "CHARACTER", "DATE", "INSTITUTION", "LOCATION"), percentile=88),
        Domain("financial", ("ACCOUNT", "ADDRESS", "AMOUNT", "COMPANY", "CURRENCY", "DATE", "RATE", "TRANSACTION"), percentile=90, cleaning=True),
        Domain("owu", tuple(_INSURANCE), strategy="section", percentile=88, cleaning=True),
    )
}


def domain(name: str) -> Domain:
    if name not in DOMAINS:
        raise ValueError(f"no domain {name!r}; there are {sorted(DOMAINS)}")
    return DOMAINS[name]


def percentile_of(names: list[str]) -> float:
    """The first domain's percentile; 90 when domains are chosen automatically."""
    return DOMAINS[names[0]].percentile if names and names[0] in DOMAINS else 90.0


def threshold(kind: Column, table: dict[str, float] | None = None, default: float = DEFAULT_THRESHOLD) -> Column:
    entries = [F.lit(x) for kv in sorted((THRESHOLDS if table is None else table).items()) for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*entries), kind), F.lit(default)) if entries else F.lit(default)


def extend_types(types: Column, more: Column) -> Column:
    """A list of entity types with those of another that it lacks, each once, in upper case."""
    return F.array_union(F.transform(types, F.upper), F.transform(more, F.upper))


def meta_instructions(reply: Column) -> Column:
    """A model's instructions for extraction: the whole reply, trimmed; null if there is nothing in it."""
    return F.nullif(F.trim(reply), F.lit(""))


def extraction_prompt(name: str, text: Column, instructions: Column, known: Column) -> Column:
    """The prompt of one domain: the model's own instructions if it gave any, else the domain's base prompt; then what is
    known from elsewhere, then the text."""
    d = DOMAINS[name]
    base = d.extraction.split("{text}")[0].replace("{types}", ", ".join(d.types))
    context = F.when(F.coalesce(F.size(known), F.lit(0)) > 0, F.concat(F.lit("\nKnown already:\n"), F.array_join(known, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    return F.concat(F.coalesce(F.concat(meta_instructions(instructions), F.lit("\n")), F.lit(base)), context, text)


def classify(reply: Column) -> Column:
    """Known domains named by a classifier's JSON reply (a list, or an object's ``domains``); ``simple`` if none is."""
    got = F.coalesce(F.from_json(reply, "array<string>"), F.from_json(F.get_json_object(reply, "$.domains"), "array<string>"))
    known = F.filter(F.transform(got, lambda x: F.lower(F.trim(x))), lambda x: x.isin(*DOMAINS))
    return F.when(F.size(known) > 0, F.array_distinct(known)).otherwise(F.array(F.lit("simple")))
