"""Explanations. The sentences are part of the results, so they are fixed values."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.functions.semantics import nearest

# Sentences with printf places.
DEMAND = (
    "La prévision est basée sur les ventes récentes du produit. La demande hebdomadaire la plus probable est estimée à %.0f unités. "
    "Dans un scénario bas, elle pourrait être d’environ %.0f unités, et dans un scénario élevé, jusqu’à %.0f unités."
)
BASELINE = "Prévision de secours (baseline) basée sur l'historique (history_weeks=%d)."
NO_DATA = "Aucun historique suffisant pour fournir une prévision."
STOCKOUT = "Risque de rupture: stock=%d, besoin lead-time(p90)≈%.1f, stock après lead≈%.1f < seuil_min=%d."
OVERSTOCK = "Risque de surstock: stock=%d > seuil_max=%d + couverture 4 semaines(p50)≈%.1f."
STOCK_OK = "Stock OK: stock=%d, seuils=[%d,%d], besoin lead-time(p90)≈%.1f."
NO_RULE = "Produit introuvable dans restock_rules."
PRICE_NO_COMPETITOR = "Aucune donnée concurrentielle: recommandation basée sur min_price, marge min et prix actuel (%s)."
PRICE_COMPETITOR = "Prix concurrent médian %.2f détecté: ajustement %s pour rester compétitif tout en respectant min_price et marge."
PRICE_ML = (
    "Prix actuel=%.2f, recommandé=%.2f (%s, %.1f%%). Concurrence médiane≈%.2f, promo_active=%d. "
    "Demande prévue (p50) au prix actuel≈%.2f/sem, au prix recommandé≈%.2f/sem (%.1f%%). "
    "Marge prévue/sem: actuelle≈%.2f, nouvelle≈%.2f, impact≈%.2f."
)
PROMO_ML = (
    "Promo ML: simulation discounts et sélection selon %s. Discount=%.0f%%, prix promo=%.2f (min_price=%.2f). "
    "Demande prévue p50≈%.2f/sem, marge prévue≈%.2f/sem."
)
PROMO_BY = ("écoulement surstock", "marge")
PROMO_NONE = "Promo ML: aucune remise feasible (min_price) ou données insuffisantes."
RESTOCK_RULES = "Réassort basé sur stock actuel=%d, seuil_min=%d, lead_time=%dj et demande prévue (p50=%.1f, p90=%.1f)."
RESTOCK_ML = (
    "Restock ML prescriptif: optimisation du coût attendu (rupture vs stockage). Stock=%.0f, lead_time=%dj, besoin lead-time p50≈%.2f. "
    "Q optimal=%d (E[rupture]≈%.2f, E[surstock]≈%.2f)."
)
TOO_LOW = "%d prix concurrents < ~%.0f%% du coût."
SHOCK = "Écart prix vs médiane concurrence ~%.0f%% (cur=%.2f, med=%.2f)."
NOT_OK = "%d entrées scrapées avec status != OK."
ANOMALY = "Anomalie ML détectée (score=%.3f). %s"
REASONS = {
    "gap_hours": "La dernière collecte est trop ancienne / irrégulière (scraping instable ou retard).",
    "log_ratio": "Le ratio prix concurrent / prix interne est atypique (prix trop haut/bas ou mauvais matching).",
    "delta_pct": "Variation du prix concurrent très brusque par rapport à l’historique (choc ou donnée incohérente).",
    "status_bad": "Le scraping a retourné un statut non OK (donnée potentiellement invalide).",
}


_place = re.compile(r"%(?:\.(\d))?([dfs%])")

# Answers for products without enough sales.
NO_SALES = "Pas de ventes pour ce produit."
SHORT_HISTORY = "Historique insuffisant (<4 semaines) pour %s ML."


def say(template: str, *values: Column) -> Column:
    """The template with its places filled; numbers with decimals are rounded as Python does before they are written."""
    kinds = [m for m in _place.findall(template) if m[1] != "%"]
    return F.format_string(template, *[nearest(v.cast("double"), int(digits)) if kind == "f" else v for v, (digits, kind) in zip(values, kinds, strict=True)])


def reason(feature: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, feature), F.concat(F.lit("Feature atypique: "), feature, F.lit(".")))
