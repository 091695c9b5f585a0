"""A grammar of refusals, compiled to one word automaton per kind of sentence.

A sentence declines when its words run through a frame: who (the speaker, the sources, the question), a denial, and
what is denied (answering, covering, knowing, having information). Frames are sequences of slots with short gaps, for
each of four languages; slots are word classes, not phrases, so the wording need not have been seen before. Further
frames tell sentences that add no substance to a refusal: apologies, offers to the reader, what the sources are about.
"""

from __future__ import annotations

import re
from functools import lru_cache

_WORD = re.compile(r"[^\W_]+")

# Word classes: who or what is spoken of.
SOURCES = {
    "en": "sources? passages? excerpts? snippets? chunks? library retrieved",
    "de": "quellen? ausz(?:ü|ue)gen? textstellen? passagen? unterlagen fundstellen? bibliothek belegen? abschnitten? textausschnitten?",
    "es": "fuentes? fragmentos? pasajes? extractos? biblioteca",
    "fr": "sources? extraits? passages? biblioth(?:è|e)que",
}
TEXTS = {
    "en": "papers? documents? texts? articles? abstracts? literature publications? material materials context corpus collection references? database records?",
    "de": "dokumenten? texten? papieren? arbeiten artikeln? material kontext sammlung literatur publikationen korpus",
    "es": "documentos? textos? artículos? materiales material contexto trabajos colección literatura corpus publicaciones",
    "fr": "documents? textes? articles? contexte corpus collection littérature travaux matériel publications éléments",
}
# What points to the question or to the answer as such.
ASKED = {
    "en": "this that it these those your you asked question questions topic topics subject matter issue point request query such anything enough any provided ingested given available supplied hand here what answer answers reply",
    "de": "dies diese diesem diesen dieser dieses das dazu hierzu darüber davon frage fragen thema punkt hierüber danach gefragte etwas vorliegenden bereitgestellten genug angaben gefragt anliegen",
    "es": "esto eso esta este esa ese ello pregunta tema cuestión punto asunto consulta nada suficiente respecto preguntado disponibles recuperados proporcionados",
    "fr": "ceci cela cette ce cet question sujet thème point demande rien suffisamment y propos là dessus disponibles fournis récupérés",
}
# What is denied: acts of answering, of covering, and the information itself.
ANSWERING = {
    "en": "answer answered answering say tell help assist respond reply comment speak address advise determine judge conclude provide offer give state confirm explain elaborate guess speculate clarify verify comply support share find locate identify discuss establish resolve settle infer derive deduce",
    "de": "beantworten beantwortet sagen helfen antworten angeben beurteilen mitteilen weiterhelfen dienen geben machen äußern entnehmen ermitteln feststellen bestimmen erteilen klären finden beantwortbar ableiten spekulieren festlegen",
    "es": "responder responderle contestar contestarle decir decirle ayudar ayudarle indicar opinar comentar determinar precisar ofrecer dar encontrar aclarar afirmar saber atender resolver deducir concluir especular respuesta pronunciarme",
    "fr": "répondre dire aider préciser indiquer commenter déterminer donner fournir trouver conclure affirmer renseigner éclairer traiter savoir déduire prononcer établir spéculer réponse",
}
COVERING = {
    "en": "contain contains cover covers discuss discusses mention mentions address addresses provide provides include includes answer answers say says tell describe describes report reports specify specifies give gives state states touch touches treat treats speak speaks offer offers explain explains examine examines explore deal deals shed sheds relate relates reveal bear bears hold allow allows permit permits help enable supply present indicate consider refer refers inform settle resolve suffice support supports concern concerns",
    "de": "enthalten enthält behandeln behandelt erwähnen erwähnt sagen sagt geben gibt nennen nennt beantworten beantwortet besprechen bieten bietet liefern liefert decken thematisieren erlauben ermöglichen äußern hergeben beschreiben erklären erläutern eingehen gehen reichen machen belegen berichten aufgreifen",
    "es": "contienen contiene mencionan menciona dicen dice tratan trata hablan habla cubren cubre abordan aborda incluyen incluye ofrecen ofrece proporcionan proporciona aportan aporta responden responde permiten permite explican explica recogen indican discuten describen bastan aclaran contestan dan refieren",
    "fr": "disent dit contiennent contient mentionnent mentionne parlent parle abordent aborde traitent traite couvrent couvre fournissent fournit permettent permet donnent donne évoquent évoque répondent répond précisent précise comportent suffisent indiquent expliquent offrent apportent renseignent discutent portent décrivent",
}
COVERED = {
    "en": "covered discussed mentioned addressed present found contained included available described answered treated answerable supported documented stated specified explained dealt provided touched considered",
    "de": "behandelt erwähnt abgedeckt besprochen enthalten beantwortet thematisiert finden entnehmen gefunden genannt beschrieben beantwortbar vorhanden erörtert angesprochen aufgeführt",
    "es": "tratado tratada mencionado mencionada cubierto cubierta abordado abordada incluido respondida respondido disponible contestada aparece figura consta menciona aborda trata encuentra",
    "fr": "traité traitée abordé abordée mentionné mentionnée couvert couverte évoqué évoquée présent disponible répondue traitée figure trouve discuté discutée",
}
INFORMATION = {
    "en": "information details? mention answers? indication discussion basis grounds passages? material context knowledge idea clue reply response coverage content guidance account treatment excerpts? sources? papers? documents? data evidence",
    "de": "informationen information angaben daten antwort hinweise? belege? aussagen? auskunft erkenntnisse kenntniss?e? passagen stellen? grundlage unterlagen wissen ahnung textstellen quellen",
    "es": "información datos respuesta detalles evidencia mención elementos base conocimiento constancia pasajes? fragmentos? fuentes? idea documentos? indicación",
    "fr": "informations? données? réponse détails? éléments? mention base connaissances? passages? extraits? sources? idée indication renseignements? documents?",
}
# Contrast: what follows may say something after all.
CONTRAST = re.compile(r" (?:but|however|whereas|nevertheless|nonetheless|still|yet|instead|aber|jedoch|sondern|dennoch|hingegen|pero|sino|sin embargo|no obstante|mais|cependant|toutefois|en revanche) ")
#: Words without one of which no sentence declines, and the least words of a clause that can carry substance.
CUES = set(
    "t n not cannot no none nothing never neither nor nowhere without unable silent silence insufficient lack lacks outside beyond impossible decline declines declined refuse refuses pass abstain refrain fail fails little unknown ai "
    "nicht nichts kein keine keinen keinem keiner keinerlei weder nirgends ohne außerhalb jenseits lehne verweigere verzichte passen ablehnen unbekannt unmöglich schweigen schweigt ahnung "
    "ningún ninguno ninguna nada nunca sin fuera niego declinar declino rechazar abstengo rehúso carezco carecen desconozco ignoro imposible silencio allá callan "
    "ne aucun aucune rien jamais ni hors impossible refuse décliner refuser abstiens ignore muets silence silencieux sans préfère".split()
)
LEAST = 4


def normal(sentence: str) -> str:
    """Lower-case words of a sentence, each with a blank on both sides of it; contractions are written out."""
    s = sentence.lower()
    if "'" in s:
        s = _written_out(s)
    return (" " + " ".join(_WORD.findall(s)) + " ").replace(" cannot ", " can not ")


def _written_out(s: str) -> str:
    s = s.replace("can't", "can not").replace("won't", "will not").replace("n't", " not").replace("i'm", "i am").replace("'re ", " are ").replace("'ve ", " have ").replace("'ll ", " will ").replace("'d ", " would ")
    s = s.replace(" n'", " ne ")
    if s.startswith("n'"):
        s = "ne " + s[2:]
    return s


def _any(words: str) -> str:
    return "(?:" + "|".join(words.split()) + ")"


def _gap(n: int) -> str:
    return rf"(?: [^ ]+){{0,{n}}} "


@lru_cache(maxsize=1)
def automata() -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """(declining, needing a pointer to the question, adding nothing): the compiled frames, on normal() sentences."""
    src, txt, ans, cov, done, info = ({k: _any(v) for k, v in x.items()} for x in (SOURCES, TEXTS, ANSWERING, COVERING, COVERED, INFORMATION))
    both = {k: f"(?:{src[k]}|{txt[k]})" for k in src}
    g = _gap
    sure, maybe, idle = [], [], []
    # English: the speaker cannot, will not, does not know, has nothing.
    sure += [
        f"(?:i|we){g(2)}(?:can not|could not|(?:am|are|was|were|be|feel)(?: [^ ]+)? (?:not able|unable|not in a position|not equipped|not qualified|not permitted|not allowed)|have no way|lack){g(4)}{ans['en']}",
        f"(?:not able|unable|impossible for me|not in a position) to{g(3)}{ans['en']}{g(4)}(?:this|that|it|your|you|question|request|asked)",
        f"i{g(3)}(?:refuse|decline|abstain|refrain|rather not|prefer not|pass on|will not|would not|must pass|have to pass|hesitate)",
        f"we{g(3)}(?:refuse|decline|prefer not|rather not){g(2)}{ans['en']}",
        f"i (?:[^ ]+ ){{0,2}}(?:do not|did not|can not|could not)(?: [^ ]+)? (?:know|find|see|locate|have|possess|hold|recall|understand|identify|come)",
        f"i (?:[^ ]+ )?(?:have|had|see|saw|find|found|know|hold|possess|located|retrieved|was given|came across|got){g(2)}(?:no|nothing|none|little|insufficient|not enough|too little)",
        f"i (?:[^ ]+ )?(?:lack|am not sure|am not certain|am not aware|am not familiar|am no expert|am at a loss|am ignorant)",
        f"(?:leave|leaves|left|leaving|gives|give|gave|offers?|provides?|tells?) me{g(2)}(?:without|no|nothing|unable|not)",
        f"as an? (?:[^ ]+ )?(?:ai|assistant|language model){g(8)}(?:not|unable|no)",
        f"no (?:[^ ]+ )?(?:answer|reply|response|statement|conclusion) (?:[^ ]+ )?(?:can|could|may|is|was|will)(?: not)? (?:be )?(?:given|offered|made|drawn|provided|possible|available|found|reached)",
        f"(?:none|neither|nothing|nowhere|no part|not one|not a single one) (?:of|in|from|among|within|across)(?: [^ ]+){{0,4}} {both['en']}",
        f"nothing (?:[^ ]+ )?(?:retrieved|provided|ingested|supplied|available|relevant|found|in the library|at hand)",
        f"(?:no|not any|not enough|insufficient|too few|too little) (?:[^ ]+ ){{0,3}}{info['en']} (?:[^ ]+ ){{0,5}}(?:found|retrieved|available|located|returned|present|provided|to answer|to respond|to say|to reply|to tell|to help|to go on)",
        f"{src['en']}{g(6)}(?:(?:do|does|did|can|could|would|will|is|are) not|fails? to|never|hardly|barely|scarcely){g(2)}{cov['en']}",
        f"{both['en']}{g(4)}(?:(?:is|are|remain|remains|stay|stays|fall|falls) silent|says? nothing|tells? (?:me |us |you )?nothing|(?:contains?|has|have|offers?|provides?|gives?|includes?|holds?) (?:no|nothing|little|none|insufficient)(?: [^ ]+){{0,3}} (?:{info['en']}|on|about|regarding|concerning|relevant))",
        f"{src['en']}{g(4)}(?:lacks?|omits?){g(3)}{info['en']}",
        f"not(?: [^ ]+){{0,2}} {done['en']}(?: [^ ]+){{0,2}} (?:by|in|within|among|anywhere|from|with)(?: [^ ]+){{0,4}} {both['en']}",
        f"(?:outside|beyond|out of|not within|exceeds?)(?: [^ ]+){{0,4}} (?:{both['en']}|what i|my (?:[^ ]+ )?(?:scope|knowledge|reach|remit|abilities|expertise|competence))",
        f"your guess is as good",
    ]
    maybe += [
        f"{txt['en']}{g(6)}(?:(?:do|does|did|can|could|would|will|is|are) not|fails? to|never|hardly|barely){g(2)}{cov['en']}",
        f"(?:this|that|it|question|topic|matter|request|subject|answer|you asked) (?:[^ ]+ ){{0,3}}(?:can not|could not|may not)(?: [^ ]+)? be (?:[^ ]+ )?(?:{ans['en']}|answered|determined|resolved|addressed|said|established|inferred|derived|settled|verified|found|given|located|confirmed)",
        f"(?:this|that|it|question|topic|matter|request|subject|you asked)(?: [^ ]+){{0,3}} not(?: [^ ]+)? {done['en']}",
        f"(?:it|that) (?:is|was|seems|proves|remains) (?:[^ ]+ )?(?:not possible|impossible|not feasible|not able)(?: for me)? to (?:[^ ]+ )?{ans['en']}",
        f"(?:this|that|it|question|topic|request|subject)(?: [^ ]+){{0,3}} (?:outside|beyond|out of|not within|exceeds?)(?: [^ ]+){{0,3}} (?:scope|range|remit|reach|coverage|knowledge|what|bounds|limits|{both['en']})",
        f"(?:there (?:is|are|was|were|exists?)|we have|with)(?: [^ ]+){{0,2}} (?:no|not enough|not any|too little|insufficient|nothing|little)(?: [^ ]+){{0,3}} {info['en']} (?:on|about|regarding|concerning|for|of|to|in|within|from|here|that (?:would|could|lets?|allows?|answers?))",
        f"^ (?:unfortunately |sorry |regrettably |alas |there is |there are )*(?:insufficient|no|not enough|too little)(?: [^ ]+){{0,3}} {info['en']}(?: [^ ]+){{0,2}} $",
    ]
    # German.
    sure += [
        f"(?:ich|wir|mir|uns|man|sich)(?: [^ ]+){{0,8}} (?:nicht|nichts|kein[a-z]*)(?: [^ ]+){{0,4}} {ans['de']}",
        f"(?:liegen|liegt|habe|haben|gibt|finde|fand|finden|fanden|besitze|verfüge|fehlen|fehlt|kenne)(?: [^ ]+){{0,5}} (?:kein[a-z]*|nicht genug|nicht genügend|nichts|zu wenig)(?: [^ ]+){{0,3}} (?:{info['de']}|gefunden|vor)",
        f"(?:fehlen|fehlt) (?:mir|uns)(?: [^ ]+){{0,5}} {info['de']}",
        f"(?:weiß|weiss)(?: [^ ]+){{0,3}} (?:nicht|nichts)", f"(?:habe )?(?:leider )?keine ahnung", f"ist mir(?: [^ ]+){{0,2}} (?:nicht bekannt|unbekannt)",
        f"ich(?: [^ ]+){{0,4}} (?:ablehnen|passen|lieber nicht|nicht kommentieren)", f"(?:lehne|verweigere|verzichte|enthalte)(?: [^ ]+){{0,2}} ich", f"ich (?:[^ ]+ )?(?:lehne|verweigere|verzichte|passe|enthalte|bedauere)", f"möchte ich(?: [^ ]+){{0,3}} nicht",
        f"{both['de']}(?: [^ ]+){{0,6}} (?:kein[a-z]*|nichts|nicht|weder)(?: [^ ]+){{0,4}} (?:{cov['de']}|{info['de']}|{done['de']}|aus|ein|her|dazu|darüber|hierzu)",
        f"{both['de']}(?: [^ ]+){{0,3}} (?:{cov['de']}|schweigen|schweigt)(?: [^ ]+){{0,5}} (?:kein[a-z]*|nichts|nicht|dazu|darüber|hierzu) ", f"{both['de']}(?: [^ ]+){{0,3}} (?:schweigen|schweigt)",
        f"(?:keine|keiner|keines|nirgends|nichts)(?: [^ ]+){{0,3}} {both['de']}", f"(?:außerhalb|jenseits)(?: [^ ]+){{0,4}} (?:{both['de']}|umfangs|rahmens|bereichs|themas|wissens|kenntnisse|möglichkeiten)",
        f"keine (?:[^ ]+ ){{0,2}}{info['de']} (?:[^ ]+ ){{0,4}}(?:gefunden|vorhanden|verfügbar|vor)", f"(?:lässt|läßt|lassen) sich(?: [^ ]+){{0,6}} (?:nicht|nichts|kein[a-z]*)(?: [^ ]+){{0,3}} {ans['de']}",
    ]
    maybe += [
        f"(?:nicht|nichts|kaum|unmöglich)(?: [^ ]+){{0,2}} (?:möglich|zu)(?: [^ ]+){{0,6}} {ans['de']}", f"unmöglich(?: [^ ]+){{0,6}} {ans['de']}", f"(?:frage|thema|punkt|das|dies|dazu)(?: [^ ]+){{0,6}} nicht(?: [^ ]+)? (?:{done['de']}|{ans['de']})",
        f"(?:wird|werden|ist|sind)(?: [^ ]+){{0,5}} nicht(?: [^ ]+)? {done['de']}",
    ]
    # Spanish.
    sure += [
        f"no (?:me |nos |se |le |lo |os )?(?:puedo|podemos|podría|pude|pudimos|sabría|soy capaz|estoy en condiciones|logro|logré|consigo|quiero|voy a|deseo|me atrevo|estoy autorizado)",
        f"no (?:lo |los |la )?(?:sé|sabemos|conozco|tengo|dispongo|disponemos|cuento|encuentro|encontré|hallo|hallé|veo|he (?:encontrado|hallado|visto))", f"(?:desconozco|ignoro|carezco|me niego|declino|rehúso|me abstengo|debo declinar|debo rechazar|prefiero no|preferiría no|tengo que declinar|tengo que rechazar)",
        f"{both['es']}(?: [^ ]+){{0,6}} no (?:[^ ]+ )?{cov['es']}", f"{both['es']}(?: [^ ]+){{0,5}} (?:nada|ning[úu]n[ao]?|silencio|callan|carecen)", f"ning[úu]n[ao]?(?: [^ ]+){{0,2}} (?:de )?(?:[^ ]+ )?(?:{both['es']}|{info['es']})", f"nada (?:de|en)(?: [^ ]+){{0,3}} {both['es']}",
        f"no (?:hay|existe|existen|se (?:han )?(?:encontró|encontraron|encontrado|dispone|halló|hallaron))(?: [^ ]+){{0,3}} {info['es']}", f"(?:fuera|más allá)(?: [^ ]+){{0,3}} (?:alcance|ámbito|conocimiento|conocimientos|{both['es']})",
        f"no (?:es|resulta|me es) posible(?: [^ ]+){{0,3}} {ans['es']}", f"(?:es )?imposible(?: [^ ]+){{0,2}} {ans['es']}", f"sin (?:[^ ]+ )?{info['es']}(?: [^ ]+){{0,3}} (?:para|suficiente|no puedo)",
    ]
    maybe += [f"no (?:se |está |es |ha sido |figura |aparece )?(?:[^ ]+ )?{done['es']}", f"no se puede(?: [^ ]+){{0,2}} {ans['es']}"]
    # French.
    sure += [
        f"je ne (?:[^ ]+ )?(?:sais|peux|puis|saurais|dispose|trouve|connais|souhaite|veux|vois|parviens|pourrais|suis pas|possède|détiens|ai|m)", f"je ne(?: [^ ]+){{0,2}} (?:ai|vois|trouve)", f"(?:j ignore|je l ignore|je refuse|je préfère ne|je préférerais ne|je dois décliner|je dois refuser|je m abstiens|je décline|je manque|je regrette de ne)",
        f"nous ne(?: [^ ]+){{0,2}} (?:pouvons|savons|disposons)(?: [^ ]+){{0,5}} (?:{ans['fr']}|{info['fr']}|pas)",
        f"{both['fr']}(?: [^ ]+){{0,6}} ne (?:[^ ]+ ){{0,2}}{cov['fr']}", f"{both['fr']}(?: [^ ]+){{0,5}} (?:rien|aucune?|silence|muets|muettes|silencieux|silencieuses)", f"aucune?(?: [^ ]+){{0,2}} (?:{both['fr']}|{info['fr']})", f"rien(?: [^ ]+){{0,2}} (?:dans|de)(?: [^ ]+){{0,3}} {both['fr']}",
        f"(?:hors|au delà|en dehors|sort|dépasse)(?: [^ ]+){{0,4}} (?:sujet|champ|portée|cadre|périmètre|connaissances|compétences|{both['fr']})", f"impossible(?: [^ ]+){{0,3}} {ans['fr']}", f"il ne y a(?: [^ ]+){{0,4}} {info['fr']}",
    ]
    maybe += [f"(?:ne|pas)(?: [^ ]+){{0,2}} (?:pas|été)(?: [^ ]+)? {done['fr']}", f"on ne peut(?: [^ ]+){{0,3}} {ans['fr']}", f"il ne est pas possible(?: [^ ]+){{0,3}} {ans['fr']}"]
    # Sentences that add nothing: apologies, offers to the reader, what the sources are about.
    idle += [
        "^ (?:my |please accept my |with )?(?:apologies|sorry|unfortunately|regrettably|i am sorry|i apologise|i apologize|i regret|my regrets|pardon)(?: [^ ]+){0,4} $",
        "^ (?:leider|entschuldigung|verzeihung|tut mir leid|es tut mir leid|bedaure|lo siento|lo lamento|disculpe|perdón|lamentablemente|désolé|désolée|je suis désolée?|pardon|malheureusement|je regrette)(?: [^ ]+){0,4} $",
        "^ (?:please|try|consider|perhaps you|maybe you|you (?:could|can|may|might|should|would)|feel free|let me know|i (?:would be|am) (?:happy|glad)|happy to|if you|is there|would you|do you|can i|could you|may i|what else|adding|rephrasing)",
        "^ (?:bitte|versuchen|versuche|sie (?:können|könnten)|vielleicht|gibt es|möchten|wenn sie|kann ich|wollen|gerne)", "^ (?:por favor|intente|intenta|pruebe|puede|podría|hay algo|desea|si (?:desea|quiere)|quizá|tal vez|consulte|añada|reformule)",
        "^ (?:veuillez|essayez|vous (?:pouvez|pourriez)|y a t il|souhaitez|si vous|ne hésitez|avez vous|peut être|consultez|ajoutez|merci de)",
        f"^(?: [^ ]+){{0,3}} {both['en']}(?: [^ ]+){{0,6}} (?:concern|concerns|discuss|are about|is about|deal|deals|cover|covers|focus|focuses|treat|treats|address|addresses|describe|mention|mentions|talk|relate)",
        f"^(?: [^ ]+){{0,3}} {both['de']}(?: [^ ]+){{0,4}} (?:betreffen|betrifft|behandeln|behandelt|handeln|drehen|befassen|beschreiben)", f"^(?: [^ ]+){{0,3}} {both['es']}(?: [^ ]+){{0,4}} (?:tratan|trata|hablan|conciernen|abordan|versan|describen|se refieren)",
        f"^(?: [^ ]+){{0,3}} {both['fr']}(?: [^ ]+){{0,4}} (?:concernent|traitent|portent|parlent|abordent|décrivent|évoquent)",
    ]
    made = lambda frames: re.compile("|".join(f if f.startswith("^") else f" {f}(?= )" for f in frames))
    return made(sure), made(maybe), made(idle)


_POINTERS = {w for v in ASKED.values() for w in v.split()}


def declines(sentence: str, found: list[str]) -> bool:
    """Whether the sentence declines to answer and says nothing after a contrast; found holds its lower-case words."""
    if CUES.isdisjoint(found):  # most sentences
        return False
    words = normal(sentence)
    sure, maybe, idle = automata()
    about = lambda s: bool(sure.search(s)) or (not _POINTERS.isdisjoint(s.split()) and bool(maybe.search(s)))
    clauses = [f" {c.strip()} " for c in CONTRAST.split(words) if c.strip()]
    if not any(about(c) for c in clauses):
        return False
    return all(about(c) or len(c.split()) < LEAST or idle.search(c) for c in clauses)


def idle(sentence: str) -> bool:
    """Whether a sentence beside a refusal adds nothing to it."""
    return bool(automata()[2].search(normal(sentence)))
