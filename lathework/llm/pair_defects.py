"""Broken prompt and response pairs: ordered rules, each of which emits its defect type."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .answers import Answer, asked_language, dissect, language, said, says_nothing, script
from .text import bag_overlap, words

# How answers decline, by language. Patterns over lower-cased text.
REFUSALS = {
    "en": [
        r"\b(?:can ?not|can't|could not|couldn't|unable to|not able to|won't be able to|will not be able to) (?:\w+ ){0,2}?(?:help|assist|answer|provide|offer|give|complete|comply|continue|discuss|respond|support|write|create|do|fulfil|fulfill|share|produce|recommend|suggest|engage)",
        r"\bmust (?:decline|refuse)|\bhave to (?:decline|refuse|pass)|\bi (?:decline|refuse)\b|\bi(?:'d| would) rather not\b|\bprefer not to\b",
        r"\bnot (?:feel )?comfortable\b|\bdon't feel comfortable|\bagainst my (?:guidelines|policy|policies|rules|principles)|\bviolates? (?:my|our|the) (?:guidelines|polic)",
        r"\boutside (?:what|of what|my|the scope)|\bbeyond what i\b|\bnot (?:something|a topic|a thing) (?:that )?i (?:can|am|could)|\bnot allowed to\b|\bnot permitted to\b",
        r"\b(?:request|question|topic) (?:is |was |has been )?(?:declined|denied|refused|rejected)|\bno (?:response|answer|recipe|help|advice) (?:is|can be|will be) (?:available|given|provided|offered)",
        r"\bnot (?:be )?appropriate (?:for me )?to\b|\binappropriate (?:for me )?to\b|\btherefore i will not\b|\bi will (?:leave it there|not answer|not be answering)",
        r"\bas an? (?:ai|artificial|language|large language|virtual)\b[^.]{0,40}\b(?:cannot|can't|can not|do not|don't|unable|not)\b",
        r"\bcan(?:no|')t (?:help|assist)|\bi (?:will|shall) not (?:answer|respond|help)",
    ],
    "de": [r"\bkann (?:ich )?(?:\w+ ){0,4}?(?:nicht|keine[nrs]?) (?:\w+ ){0,3}?(?:helfen|beantworten|antworten|geben|anbieten|unterstützen|schreiben)", r"\bmuss (?:ich )?(?:\w+ ){0,3}?(?:ablehnen|passen)", r"\bmöchte (?:ich )?(?:\w+ ){0,3}?nicht (?:beantworten|antworten|darüber)", r"\bleider (?:kann|darf|muss|nicht)\b|\bnicht (?:helfen|weiterhelfen)\b", r"\bgegen meine (?:richtlinien|regeln)|\bnicht erlaubt\b|\banfrage abgelehnt"],
    "fr": [r"\bje ne (?:peux|puis|suis) (?:malheureusement )?pas\b[^.]{0,40}\b(?:aider|répondre|fournir|donner|autorisé|en mesure)", r"\bje (?:dois|me vois) (?:\w+ )?(?:refuser|décliner|contraint)|\bje préfère ne pas\b|\bje refuse\b", r"\bcontraire à mes (?:règles|consignes|directives)|\bdemande (?:refusée|rejetée)|\bimpossible de (?:répondre|vous aider)", r"\bdésolé[^.]{0,40}\bpas\b"],
    "es": [r"\bno puedo (?:\w+ ){0,2}?(?:ayudar|responder|dar|ofrecer|proporcionar|escribir|ayudarte|ayudarle|contestar)", r"\b(?:debo|tengo que) (?:rechazar|declinar|negarme)|\bprefiero no\b|\bme niego\b", r"\bcontra mis (?:normas|reglas|directrices|pautas)|\bsolicitud (?:rechazada|denegada)|\bno (?:me está|está) permitido", r"\blo siento[^.]{0,50}\bno\b"],
    "pt": [r"\bnão posso (?:\w+ ){0,2}?(?:ajudar|responder|dar|oferecer|fornecer|escrever|ajudá)", r"\b(?:devo|tenho de|tenho que|preciso) (?:recusar|declinar)|\bprefiro não\b|\brecuso\b", r"\bcontra as minhas (?:regras|diretrizes|normas)|\bpedido (?:recusado|negado)|\bnão (?:me )?é permitido", r"\b(?:lamento|desculpe|sinto muito)[^.]{0,50}\bnão\b"],
    "it": [r"\bnon (?:posso|riesco a|sono in grado di) (?:\w+ ){0,2}?(?:aiutar\w*|risponder\w*|fornir\w*|dar\w*|offrir\w*|scriver\w*)", r"\b(?:devo|preferisco) (?:\w+ )?(?:rifiutare|declinare|non rispondere)|\bmi rifiuto\b", r"\bcontro le mie (?:regole|linee guida)|\brichiesta (?:rifiutata|respinta)|\bnon (?:mi )?è (?:permesso|consentito)", r"\b(?:mi dispiace|purtroppo)[^.]{0,50}\bnon\b"],
    "pl": [r"\bnie (?:mogę|moge|jestem w stanie) (?:\w+ ){0,2}?(?:pomóc|odpowiedzieć|podać|udzielić|zaoferować|napisać)", r"\b(?:muszę|wolę) (?:\w+ )?(?:odmówić|nie odpowiadać)|\bodmawiam\b", r"\bwbrew moim (?:zasadom|wytycznym)|\bprośba (?:odrzucona|odmówiona)|\bnie (?:wolno mi|jest dozwolone)", r"\b(?:przepraszam|niestety|przykro mi)[^.]{0,50}\bnie\b"],
    "sv": [r"\bkan (?:jag )?(?:\w+ ){0,3}?(?:inte|ingen|inget) (?:\w+ ){0,3}?(?:hjälpa|svara|ge|erbjuda|skriva)", r"\b(?:måste|vill) (?:jag )?(?:\w+ ){0,2}?(?:avböja|avstå|neka)|\bjag vägrar\b", r"\bmot mina (?:riktlinjer|regler)|\bbegäran (?:nekad|avslagen)|\binte tillåtet", r"\b(?:tyvärr|förlåt|beklagar)[^.]{0,50}\binte\b"],
    "da": [r"\bkan (?:jeg )?(?:\w+ ){0,3}?(?:ikke|ingen) (?:\w+ ){0,3}?(?:hjælpe|svare|besvare|give|tilbyde|skrive)", r"\b(?:må|vil) (?:jeg )?(?:\w+ ){0,2}?(?:afslå|afvise|takke nej)|\bjeg nægter\b", r"\bmod mine (?:retningslinjer|regler)|\banmodning (?:afvist|nægtet)|\bikke tilladt", r"\b(?:desværre|beklager|undskyld)[^.]{0,50}\bikke\b"],
    "nl": [r"\bkan (?:ik )?(?:\w+ ){0,4}?(?:niet|geen) (?:\w+ ){0,3}?(?:helpen|beantwoorden|antwoorden|geven|bieden|schrijven)", r"\bmoet (?:ik )?(?:\w+ ){0,3}?(?:weigeren|afwijzen|passen|afslaan)", r"\bliever niet\b|\bik weiger\b", r"\btegen mijn (?:richtlijnen|regels)|\bverzoek (?:geweigerd|afgewezen)|\bniet toegestaan", r"\b(?:helaas|sorry)[^.]{0,50}\bniet\b"],
}
_REFUSAL = re.compile("|".join(p for ps in REFUSALS.values() for p in ps))
#: A refusal says little else: at most so many words beside the sentences that decline, and no more than twice theirs.
_ASIDE = 30
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")
#: A language shows where its function words lead by this share of all words, and by this many.
_SHARE, _WORDS = 0.06, 1.5


def refuses(pieces: list[str]) -> bool:
    """Whether the pieces decline instead of answering: sentences that decline make up the answer but for courtesies."""
    declining = rest = 0
    for p in pieces:
        for s in _SENTENCE.split(p.lower().replace("’", "'")):
            if _REFUSAL.search(s):
                declining += len(words(s))
            else:
                rest += len(words(s))
                if rest > _ASIDE:
                    return False
    return declining > 0 and rest <= 2 * declining + 6


def copies(given: list[str], own: list[str]) -> bool:
    """Whether an answer's words give back the prompt's and nothing more: nearly the same bag, or the greater part of it and hardly another word."""
    if len(own) < 4 or not given or len(given) * 3 > len(own) * 4 + 3:
        return False
    a, b = Counter(own), Counter(given)
    if bag_overlap(a, b) >= 0.75:
        return True
    return len(given) >= 8 and sum((a & b).values()) >= 0.9 * len(given) and 2 * len(given) >= len(own)


def speaks_otherwise(pieces: list[str], given: list[str], prompt: str, own: list[str], asked: str | None) -> bool:
    """Whether the answer is in another script or language than the prompt asks for or, if it asks for none, is written in.

    Scripts come first: any piece of another script is one in another language, whatever the two scripts are.
    """
    expected = "latin" if asked else script(prompt)
    if expected and any(script(p) not in (expected, None) for p in pieces):
        return True
    wanted, sure = (asked, len(own)) if asked else language(own)
    if wanted is None:
        return False
    got, lead = language(given)
    return got is not None and got != wanted and lead >= max(_WORDS, _SHARE * len(given)) and sure >= 0.04 * len(own)


def defects(prompt: str | None, response: str | None, a: Answer | None = None) -> list[str]:
    """The defects of a pair but for truncation, in the order of the rules; ``a`` is the answer's anatomy, if known."""
    if response is None:
        return ["empty"]
    a = a or dissect(response)
    if says_nothing(a):
        return ["empty"]
    pieces, found = said(a), []
    body = [v for k, v in a.values if k not in ("title", "unit") and v.strip()] if a.closed is not None else pieces
    if refuses(body or pieces):
        found.append("refusal")
    if not prompt:
        return found
    own, given = words(prompt), words("\n".join(v for k, v in a.values if k != "unit") + "\n" + "\n".join(pieces[: len(pieces) - len([1 for _, v in a.values if v.strip()])]))
    asked = asked_language(prompt)
    copied = copies(given, own)
    if copied:
        found.append("copied_prompt")
    if (not copied or asked) and speaks_otherwise(pieces, given, prompt, own, asked):
        found.append("other_language")
    return found


def pair_defects(pairs: DataFrame, truncated: DataFrame | None = None) -> DataFrame:
    """``id, defect``: a row for every defect of every pair.

    pairs: ``id, prompt, response`` and, if it has one, ``source``; other columns are ignored. truncated: further ids known
    to be cut. Null ids are left out; a null response is empty; a null prompt leaves the rules that need it out; repeated
    rows count once; an id with several responses has the defects of all. The rules run in order: nothing said, cut,
    declined, copied, other language; all that hold are given, but what says nothing has no other defect. Cut is what has
    unclosed delimiters, an abrupt ending, or an open ending at a length whose hazard shows a limit (truncation.cuts).
    """
    from .truncation import cuts, examined

    source = F.col("source") if "source" in pairs.columns else F.lit(None).cast("string")
    seen = examined(pairs.select("id", source.alias("source"), "prompt", F.col("response").alias("text")))
    by_rule = seen.select("id", F.explode("defects").alias("defect"))
    cut = cuts(seen).select("id")
    if truncated is not None:
        cut = cut.unionByName(truncated.select("id"))
    return by_rule.unionByName(cut.select("id", F.lit("truncated").alias("defect"))).distinct()
