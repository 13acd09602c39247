"""Broken prompt and response pairs: ordered rules that emit every defect they see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.barrier import computed_once
from quarrystone.llm.endings import clean, ends_whole, is_figure, is_name, without_citations

#: In order of precedence.
DEFECTS = ("empty", "copies_question", "refusal", "truncated", "other_language")

#: Whole answers that say only that nothing was entered.
PLACEHOLDERS = (
    r"n\s?/?\s?a|n\.\s?a|n\s?/?\s?d|not (?:available|applicable|provided|entered|answered|given|yet answered|filled in)|none(?: given| provided| entered)?|null|nil|"
    r"nan|tb[dac]|to be (?:determined|added|completed|confirmed|filled in|provided)|todo|pending|blank|left blank|empty|no (?:answer|response|entry|text|value|data|content)"
    r"(?: (?:given|provided|entered|available|recorded))?|nothing(?: (?:entered|here|provided))?|missing|unanswered|answer|placeholder|insert answer here|"
    r"your answer here|answer (?:here|goes here|pending|missing|to follow)|xx+|k\.?\s?a|keine (?:angabe|antwort|angaben)|leer|entfällt|nicht (?:ausgefüllt|angegeben|vorhanden)|"
    r"noch offen|folgt|s\.?\s?o|néant|vide|aucune? (?:réponse|donnée)|non (?:renseigné|disponible|communiqué|applicable)e?|à (?:compléter|définir)|"
    r"vac[ií]o|sin (?:respuesta|datos|contenido)|no (?:disponible|aplica|procede|consta)|ningun[oa]|por (?:definir|completar)|pendiente|en blanco"
)

#: First-person ways of declining in four languages, after an optional opening.
REFUSALS = (
    r"\bi (?:am|'m) (?:sorry|afraid|unable|not able|not in a position|only an? (?:language model|ai))\b",
    r"\bi(?: am|'m)? (?:cannot|can't|can not|could not|couldn't|won't|will not|must not|may not|don't|do not|would rather not|'d rather not|prefer not to|have to (?:pass|decline)|must (?:decline|refuse|pass)|decline|refuse|have no (?:access|information|way))\b",
    r"\b(?:it's|it is) not possible for me\b",
    r"\bmy (?:guidelines|instructions|policy|rules) (?:keep|prevent|do not|don't|stop|forbid)",
    r"\bno answer can be given\b",
    r"\bnothing i was (?:shown|given)\b",
    r"\b(?:that|this) is something i (?:won't|will not|can't|cannot|am not)\b",
    r"\b(?:so|and) i (?:will|'ll|must|have to) leave this\b",
    r"\bnot enough information for me\b|\bthere is not enough information (?:here |given )?to (?:answer|respond|reply)\b",
    r"\bthis is outside what i\b|\boutside (?:of )?what i (?:can|am)\b",
    r"\b(?:passages?|context|excerpts?) (?:given |provided |shown )?(?:do|does) not (?:answer|cover|contain|say|allow me|let me)\b",
    r"\b(?:kann|darf|möchte|will|werde|muss) ich\b.*\b(?:keine|nicht|leider|ablehnen|passen)\b",
    r"\bich (?:kann|darf|möchte|bin|werde|will|habe|muss|bedaure|verfüge)\b.*\b(?:nicht|keine[nrs]?|ablehnen|passen|außerstande)\b",
    r"\bmir (?:ist es |leider )?nicht möglich\b|\bes ist mir (?:leider )?nicht möglich\b",
    r"\bauszüge reichen für eine antwort\b|\bkeine antwort geben\b",
    r"\bje (?:ne (?:suis|peux|puis|dispose|sais|saurais|souhaite)|préfère ne|regrette|refuse|dois (?:décliner|refuser))\b",
    r"\bil m'est (?:impossible|interdit)\b|\b(?:ne me|ne m') ?(?:permettent|permet|autorisent)\b",
    r"\bno (?:puedo|dispongo|tengo (?:acceso|información|datos)|me es posible|estoy en condiciones|sé responder|quiero responder)\b",
    r"\bprefiero no\b|\bme (?:es imposible|veo obligad[oa])\b|\bdebo (?:declinar|rechazar)\b",
)
#: One of these words stands in every refusal above; the patterns are tried only where one does.
REFUSAL_HINTS = (
    r"(?:^|[^\p{L}])(?:i|i'm|my|me|ich|mir|je|il m'est|answer can|nothing i|enough information|outside|passages?|context|excerpts?|auszüge|keine antwort|"
    r"no (?:puedo|dispongo|tengo|estoy|sé|quiero)|prefiero|debo)(?:$|[^\p{L}])|ne m'"
)
#: Openings that promise a refusal when nothing of substance follows.
APOLOGIES = (
    r"^(?:i'm sorry|i am sorry|sorry|my apologies|apologies|regrettably|unfortunately|thank you for asking|entschuldigung|leider|es tut mir leid|tut mir leid|"
    r"désolée?|malheureusement|je regrette|lo siento|lamentablemente|por desgracia|lo lamento)\b"
)

#: Someone who reports and what is reported stand after an apology that introduces an answer: "Unfortunately, the company lost two plants".
REPORTS = (
    r"\b(?:we|our|(?:the |its )?(?:company|group|registrant|management|board|revenues?|sales|earnings|income|margins?|costs?|demand|segment|business)|wir|unser[e]?|das unternehmen|der konzern|die gesellschaft|"
    r"nous|notre|la société|le groupe|l'entreprise|nosotros|nuestr[oa]s?|la empresa|la compañía|el grupo)\s+(?:also |again |still )?"
    r"(?:had|has|have|lost|saw|fell|rose|grew|declined|decreased|increased|dropped|reported|recorded|recognized|closed|paid|was|were|is|are|did|made|took|incurred|suffered|"
    r"hat|haben|verlor(?:en)?|sank(?:en)?|stieg(?:en)?|war(?:en)?|ist|sind|musste[n]?|a|ont|était|étaient|est|sont|avons|perdi[óo]|cay[óo]|creci[óo]|fue(?:ron)?|es|son|tuv[oi])\b"
)

#: Frames put around a question, and words that differ between two ways of writing it.
FRAMES = (
    r"^(?:(?:the )?question(?: is)?|you asked|you ask|your question(?: was| is)?|please tell me|briefly|from the annual report|in short|q|"
    r"(?:die )?frage(?: lautet)?|sie fragten|ihre frage|la question(?: est)?|vous demandez|vous avez demandé|votre question|la pregunta(?: es)?|pregunta|usted pregunt[aó]|su pregunta)\s*[:–—-]\s*"
)

#: Frequent words that belong to one of the languages.
LANGUAGE_WORDS = {
    "en": "in on but since although whereas while until unless against came earlier several certain beyond within alongside despite under after before once all both its year million billion i you my this try asking the of and is was were are by for from with that which this these those their our its have has had would could what how did does why name amounted reported be been not they there it we as at to an if such some other most all any",
    "de": "der die das den dem des und ist sind war waren bei nach mit von für im auf eine einer eines einem nicht dass weil da sodass wohingegen zugleich wurde wir welche wie hoch nennt zu zum zur über unter aus durch obwohl bevor nachdem während sich beeinflusste übertraf stärkte verringerte erhöhte",
    "fr": "le la les des du et est sont chez dans pour par avec sur une que qui ce cette ces nous au aux leur après avant parce puisque alors tandis quel quels quelle était montant elle sujet a de en un d'euros exercice",
    "it": "il lo gli la le dei della delle del di da in con su per tra che non sono stato stata ha hanno è una un uno si come più al alla sul nel nella secondo anno costi milioni",
    "pt": "o os a as do da dos das de em no na nos nas um uma e que não são foi ao à pelo pela para por com mais segundo ano sobre milhões é",
    "nl": "de het een van en in op dat die voor met zijn niet aan te bij naar uit om tot door wordt werd volgens ook deze haar jaar miljoen heeft",
    "sv": "och att det som en ett på är av för med inte den till har de om vi från kr bolaget enligt året",
    "pl": "i w na z nie do że się jest to o za od przez oraz dla był była roku spółka według",
    "es": "el la los las del y es son en con por para una que se su sus ante cual cuál fue qué menciona ya aunque porque desde mientras según sobre de un modo si bien puesto cifra ejercicio euros millones",
}


def _known(words: Column, listed: str) -> Column:
    known = sorted(set(listed.split()))
    return F.size(F.filter(words, lambda w: w.isin(*known)))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}']+", " "), " "), lambda w: w != "")


def _listed(words: Column) -> Column:
    """Those of the words that any language claims."""
    return F.filter(words, lambda w: w.isin(*sorted({x for listed in LANGUAGE_WORDS.values() for x in listed.split()})))


def language_scores(listed: Column, n: Column) -> Column:
    """Struct of the words of each language among ``listed`` and of all words, n."""
    return F.struct(*[_known(listed, words).alias(k) for k, words in LANGUAGE_WORDS.items()], n.alias("n"))


def _language(scores: str) -> Column:
    """The language with the most words, null on a tie or without any."""
    counts = {k: F.col(f"{scores}.{k}") for k in LANGUAGE_WORDS}
    top = F.greatest(*counts.values())
    leaders = sum((F.when(c == top, 1).otherwise(0) for c in counts.values()), F.lit(0))
    return F.when(leaders == 1, F.coalesce(*[F.when(c == top, F.lit(k)) for k, c in counts.items()]))


def _foreign(language: str, scores: str) -> Column:
    """Two words more, and half as many again, speak for another language than for the asked one; or hardly any word does for that."""
    asked = F.col(language)
    own = F.coalesce(*[F.when(asked == k, F.col(f"{scores}.{k}")) for k in LANGUAGE_WORDS])
    rest = F.greatest(*[F.when(asked != k, F.col(f"{scores}.{k}")) for k in LANGUAGE_WORDS])
    n = F.col(f"{scores}.n")
    return ((rest - own >= 2) & (rest >= own * 1.5)) | ((n >= 12) & (own * 25 < n))


def script(text: Column) -> Column:
    """The script of most letters: latin or other; null without letters."""
    letters = F.length(F.regexp_replace(text, r"\P{L}+", ""))
    latin = F.length(F.regexp_replace(text, r"\P{IsLatin}+", ""))
    mixed = F.when(latin * 2 >= letters, "latin").otherwise("other")
    return F.when(text.rlike(r"[\p{L}&&\P{IsLatin}]"), mixed).when(text.rlike(r"\p{L}"), "latin")


def _core(text: Column) -> Column:
    """Words of a clean question without frame, case and punctuation."""
    out = F.lower(text)
    for _ in range(3):
        out = F.regexp_replace(out, FRAMES, "")
    out = F.regexp_replace(out, r"\bfy\s?(?=\d{2,4}\b)", "fiscal ")
    out = F.regexp_replace(out, r"['’]s\b", "")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}]+", " ")
    return F.trim(F.regexp_replace(out, r"\b(?:fiscal year|financial year|fiscal|year|fy)\b ?", ""))


def _refuses(low: Column) -> Column:
    declines = F.lit(False)
    for pattern in REFUSALS:
        declines = declines | low.rlike(pattern)
    quoted = low.rlike(r"^(?:the (?:filing|report|company|note)|management|according to)\b") & ~low.rlike(APOLOGIES)
    figure = low.rlike(r"\d[\d.,]* ?(?:%|million|billion|mio|millions|millones)")
    return (low.rlike(REFUSAL_HINTS) & declines & ~quoted) | (low.rlike(APOLOGIES) & ~figure & ~low.rlike(REPORTS))


def broken_pairs(pairs: DataFrame) -> DataFrame:
    """pairs(pair_table, pair_id, question, answer, last_sentence) -> (pair_table, pair_id, defects, defect).

    ``defects`` has every defect whose rule fires, in order of precedence, ``defect`` the first, null for a sound pair.
    Null and empty answers are 'empty'; a null question fires no rule that needs it. Every row gives one row, whole
    texts are read, equal rows give equal results, other columns are left out, and nothing is shuffled.
    """
    keys = ["pair_table", "pair_id"]
    # in steps, so that each costly expression is computed once and stays small enough to be compiled
    first = computed_once(
        pairs,
        keys,
        {
            "said": clean(F.col("answer")),
            # a value of one sentence is read once
            "last": F.when(~F.col("last_sentence").eqNullSafe(F.col("answer")), clean(F.col("last_sentence"))),
            "asked": clean(F.col("question")),
            "words_q": _words(F.col("question")),
            "script_q": script(F.col("question")),
        },
    )
    first = computed_once(
        first,
        [*keys, "said", "words_q", "script_q"],
        {"tail": without_citations(F.coalesce("last", "said")), "q": _core(F.col("asked")), "listed_q": _listed(F.col("words_q"))},
    )
    bare = F.trim(F.regexp_replace("said", r"\[\d{1,4}(?:\s*[,;–-]\s*\d{1,4})*\]", ""))
    second = computed_once(first, [*keys, "tail", "q", "script_q"], {"bare": bare, "shown": without_citations(F.col("said")), "scores_q": language_scores(F.col("listed_q"), F.size("words_q"))})
    third = computed_once(
        second,
        [*keys, "tail", "q", "bare", "script_q", "scores_q"],
        {
            "low": F.lower(F.replace("bare", F.lit("’"), F.lit("'"))),
            "a": _core(F.col("bare")),
            "spoken": ~is_figure(F.col("shown")) & ~is_name(F.col("shown")),
        },
    )
    shell = F.trim(F.regexp_replace("low", r"^[\s\p{P}\p{S}]+|[\s\p{P}\p{S}]+$", ""))
    fourth = computed_once(
        third,
        [*keys, "tail", "q", "a", "bare", "script_q", "scores_q", "spoken"],
        {"shell": shell, "refusal": F.col("spoken") & _refuses(F.col("low")), "words_a": F.when(F.col("spoken"), _words(F.col("bare"))), "script_a": script(F.col("bare"))},
    )
    fourth = computed_once(
        fourth, [*keys, "q", "a", "bare", "shell", "script_q", "script_a", "scores_q", "spoken", "refusal", "words_a"], {"listed_a": _listed(F.col("words_a")), "truncated": ~ends_whole(F.col("tail"))}
    )
    fifth = computed_once(
        fourth,
        [*keys, "q", "a", "bare", "shell", "script_q", "script_a", "spoken", "refusal", "truncated"],
        {"language_q": _language("scores_q"), "words_in_q": F.array_distinct(F.split("q", " ")), "words_in_a": F.array_distinct(F.split("a", " ")), "scores_a": language_scores(F.col("listed_a"), F.size("words_a"))},
    )
    # the same placeholder once per sentence is still one
    once = F.regexp_replace("shell", r"^(.{1,40}?)(?:[\s\p{P}\p{S}]+\1)+$", "$1")
    q_words, a_words = F.col("words_in_q"), F.col("words_in_a")
    both = F.size(F.array_intersect(q_words, a_words))
    seen = {
        "empty": (F.regexp_replace("bare", r"[\p{P}\p{S}\p{Z}\p{C}]+", "") == "") | once.rlike("^(?:" + PLACEHOLDERS + ")$"),
        "copies_question": (F.col("q") != "")
        & (F.size(q_words) >= 3)
        & ((F.col("a") == F.col("q")) | ((both >= 0.9 * F.size(a_words)) & (both >= 0.75 * F.size(q_words)))),
        "refusal": F.col("refusal"),
        "truncated": F.col("truncated"),
        "other_language": F.col("spoken") & (_foreign("language_q", "scores_a") | (F.col("script_q") != F.col("script_a"))),
    }
    fired = F.array_compact(F.array(*[F.when(F.coalesce(seen[d], F.lit(False)), F.lit(d)) for d in DEFECTS]))
    return computed_once(fifth, keys, {"defects": fired}).withColumn("defect", F.try_element_at("defects", F.lit(1)))


def question_pairs(questions: DataFrame) -> DataFrame:
    return questions.select(
        F.lit("test_questions").alias("pair_table"), F.col("question_id").alias("pair_id"), "question", "answer", F.col("answer").alias("last_sentence")
    )


def generation_pairs(generations: DataFrame, questions: DataFrame) -> DataFrame:
    """Answered generations with their question; a generation whose question is unknown keeps a null question.

    A question asked by many generations is a small row on the other side of the join, and adaptive execution splits
    its partition; no rows of one question are gathered.
    """
    texts = F.transform("sentences", lambda s: F.coalesce(s["text"], F.lit("")))
    answered = generations.where("answerable").select(
        "question_id", F.col("generation_id").alias("pair_id"), F.array_join(texts, " ").alias("answer"), F.try_element_at(texts, F.lit(-1)).alias("last_sentence")
    )
    asked = questions.groupBy("question_id").agg(F.min("question").alias("question"))
    return answered.join(asked, "question_id", "left").select(
        F.lit("generations").alias("pair_table"), "pair_id", "question", "answer", "last_sentence"
    )
