"""Template residue, filler text, error pages and script notices in documents.

Texts are cut into segments (lines and sentences) whose numbers, addresses and dates are masked; equal messages are
grouped by an exact hash of the masked text over all documents and sources, and every distinct message is classified
once by phrase and placeholder rules. A strong rule decides alone. Where a rule is uncertain the recurrence decides: the
message counts when it stands in several sources, or beside another message of its kind in the same document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.actions import let
from ..session import cut

#: Texts with fewer letters and digits than this are too short to judge.
LEAST_LETTERS = 6
#: Sources in which an uncertain message must recur.
WIDE = 2
#: Least share of page words in an uncertain message and in one that decides alone, and least number of them.
PAGE_SHARE, PAGE_SHARE_SURE, PAGE_WORDS_LEAST = 0.4, 0.65, 2

#: Unfilled placeholders of common template languages, outside double quotes and back ticks. Fixed patterns, over
#: segments whose numbers are masked as #.
PLACEHOLDER = "|".join(
    [
        r"\{\{[^{}\n]*\}\}",
        r"\{%[^%\n]+%\}",
        r"<%=?[^%\n]+%>",
        r"<\?(?:php|=)",
        r"[$#]\{[^{}\n]+\}",
        r"\{(?:[A-Za-z_][A-Za-z_#]*(?:[. ][A-Za-z_][A-Za-z_#]*)*|#)\}",
        r"%\([A-Za-z_. ]+\)[sd]",
        r"(?<![\w%])%[sd](?!\w)",
        r"\[\[[A-Za-z_. ]+\]\]",
        r"<<[A-Za-z_. ]+>>",
        r"(?i:[\[<(](?:insert|enter|your|add)[ _][A-Za-z_. ]+[\]>)])",
        r"(?i:\[[A-Za-z_. ]+ (?:goes )?here\])",
        r"(?i:\([A-Za-z_. ]+: ?tb[da]\))",
        r"(?<![\w])__[A-Za-z][A-Za-z_. ]*__(?![\w(])",
        r"(?<![\w~])~[A-Z_. ]{2,}~(?![\w~])",
        r"@@[A-Za-z_. ]+@@",
        r"(?<![\w$])\$[A-Za-z][A-Za-z_. ]*\$(?![\w$])",
        r"(?<![A-Za-z])X{4,}(?![A-Za-z])",
        r"<[A-Z][A-Z_ ]{2,}>",
        r"\[[A-Z][A-Z]*[_ ][A-Z_ ]+\]",
        r"\*\|[A-Za-z_: ]+\|\*",
        r"(?<![\w%])%[A-Z][A-Z_]{2,}%(?![\w%])",
        r"(?<![\w])TK(?:TK)+(?![\w])|\(TK\)",
        r"(?<![\w])_{5,}(?![\w])",
        r"(?<![\w])#[A-Z][A-Z_]{2,}#(?![\w])",
        r"\[(?:TODO|TBD|FIXME|TBC)\b[^\]]*\]",
    ]
)
#: Filler phrases, over plain lower-case text.
FILLER = "|".join(
    [
        r"\blorem ipsum\b",
        r"\byour (?:content|text|title|headline) (?:goes )?here\b",
        r"\b(?:sample|dummy|placeholder|filler) (?:text|copy|content)\b.*(?:\bhere\b|\blayout\b|\breplace)",
        r"\bdummy (?:copy|text)\b",
        r"\breplace this (?:paragraph|text|section|sentence)\b",
        r"\bfoo bar(?: baz)?\b.*\bfoo\b",
        r"\b(test|blah|asdf|foo|xyz|blindtext)(?:[ ,]+\1){2,}",
        r"\basdf (?:asdf|jkl|qwer)\b",
        r"\bblindtext\b",
        r"\bhier steht (?:später )?(?:der|ihr) (?:inhalt|text)\b",
        r"\btexte (?:provisoire|de remplissage|factice)\b",
        r"\btexto (?:de relleno|de ejemplo|provisional|de prueba)\b",
        r"\btesto (?:segnaposto|di esempio)\b",
        r"\b(?:sample|dummy|placeholder|type|enter|insert|add|put) (?:your )?(?:text|copy|content|title|headline)s? (?:goes |go )?here\b",
        r"^\W*(?:platzhalter|placeholder|marcador de posición|espace réservé)(?:text)?\W*$|\bhier (?:kommt|folgt) (?:noch )?(?:der |ihr )?text\b",
        r"\b(?:texto|text|content|inhalt|contenido|contenu) (?:is )?(?:coming soon|to (?:come|follow)|folgt in kürze|próximamente|à venir)\b",
        r"^\W*(?:content|text|description|more (?:text|content|details)) (?:coming soon|to come|to follow|goes here)\W*$",
        r"\bthis is (?:just |only )?(?:some |a )?(?:sample|dummy|placeholder|filler|example|test) (?:text|copy|content|paragraph|sentence)\b",
        r"\bthe quick brown fox jumps\b|\bqwerty(?:uiop)? (?:qwerty|asdf)",
    ]
)
#: Words of the customary pseudo-Latin filler.
LATIN = "lorem ipsum dolor sit amet consectetur adipiscing elit sed nulla purus vivamus viverra ornare nibh felis massa magna porta lectus tempus odio risus quis arcu eiusmod tempor incididunt labore dolore aliqua enim minim veniam nostrud vestibulum pellentesque mauris donec aenean".split()
#: Titles of error pages. They stand alone or before a separator.
ERROR_TITLE = (
    r"^\W*(?:(?:http|error|fehler|erreur|errore|erro|code)(?: (?:code|status|error))?:? ?#(?![\w%])"
    r"|(?:(?:http|error|fehler|erreur) )?#? ?[-–:.]? ?(?:internal server error|bad gateway|bad request|gateway time-?out|service (?:temporarily )?unavailable|page not found|not found|forbidden|unauthorized|access denied|permission denied"
    r"|request (?:failed|timed out|timeout)|too many requests|connection (?:reset|refused|lost|timed out)|something (?:broke|went wrong)(?: on our side)?|(?:site |server )?maintenance|an? (?:unexpected |unknown )?error (?:has )?occurred|(?:your )?session (?:has )?expired"
    r"|page introuvable|accès (?:refusé|interdit)|erreur interne(?: du serveur)?|service indisponible|seite nicht gefunden|zugriff verweigert|interner serverfehler|página no encontrada|acceso denegado|error interno(?: del servidor)?|servicio no disponible|pagina non trovata|página não encontrada|страница не найдена|ページが見つかりません))"
    r" ?(?:\(#\))? ?(?:$|[.:!?;()\-–|]|nginx|apache|cloudflare)"
)
#: What error pages say. Whole sentences about the page, the server or the visitor's request.
ERROR_TEXT = "|".join(
    [
        r"^\W*(?:(?:we're |we are )?(?:sorry|apologies),? ?(?:but )?)?(?:the )?(?:request(?:ed)?|page|resource|url|address|link|document)(?: (?:resource|page|url|file|address))?(?: (?:that )?you(?:'re|'ve| were| are| have)? (?:looking|asked|requested|tried)(?: for| to (?:reach|open|access|view))?)? (?:could(?: not|n't) be (?:completed|processed|found|loaded|served)|can(?:not|'t) be (?:found|displayed|loaded|shown)|was(?: not|n't) found|has been (?:moved|deleted|removed)|is (?:broken|not available|no longer available|unavailable)|(?:does not|doesn't|no longer) exists?|has expired)",
        r"^\W*(?:the )?(?:page|resource) you (?:were|are) looking for\b",
        r"^\W*(?:this|the) (?:address|link|url) (?:does not lead|leads nowhere|is broken|has expired)",
        r"^\W*(?:the )?(?:server|service|site|archive|gateway|upstream)(?: at §url)? (?:did not (?:answer|respond)|does not (?:answer|respond)|took too long|is (?:down|offline|overloaded|not available|unavailable|under maintenance))",
        r"^\W*(?:the )?(?:replay|deal|board|deck|page) could not be (?:loaded|found|displayed|shown)",
        r"^\W*we (?:could not|couldn't|cannot|can't|were unable to|are unable to) (?:load|find|process|complete|display|show) (?:this|that|the|your) (?:page|deal|deck|request|replay|board|archive|resource)",
        r"^\W*you (?:are not allowed|do not have permission|don't have permission) to (?:see|view|access|open)",
        r"^\W*(?:this|the|that) (?:replay|deal|deck|board|game|page|content|item|file|video|session|article) (?:is|was|has been) (?:no longer available|not available|currently unavailable|unavailable|removed|deleted|not found|gone)",
        r"^\W*(?:diese|dieses|dieser|die|das) \w+ ist nicht (?:mehr )?verfügbar|^\W*(?:cette|ce|cet|la|le) \w+ n'est (?:plus|pas) disponible|^\W*(?:esta|este|la|el) \w+ (?:ya )?no está disponible",
        r"\bno route matches\b",
        r"^\W*\{\"error\": ?\{?",
        r"^\W*traceback \(most recent call last\)",
        r"^\W*la page (?:demandée|que vous) ",
        r"^\W*le serveur (?:ne répond|a mis)",
        r"^\W*die (?:angeforderte |gesuchte )?seite (?:kann|konnte|existiert|wurde)",
        r"^\W*der server (?:antwortet|ist) ",
        r"^\W*la página (?:solicitada|que busca)",
        r"^\W*el servidor (?:no responde|tardó)",
        r"^\W*error (?:establishing|connecting|loading|processing|opening|reading|retrieving|fetching|while (?:loading|processing|fetching))\b|^\W*(?:your|this) (?:connection|site) is not (?:private|secure)\b|^\W*(?:dns|ssl|proxy|server|network|application|client|script) error\b",
        r"^\W*(?:php )?(?:fatal|parse|uncaught|unhandled|runtime|syntax|segmentation|database|internal) (?:error|exception|fault)\b ?[:(!.]",
        r"^\W*(?:warning|notice|deprecated): \w+\(\)|\bstack trace:|^\W*at [\w.$]+\([\w.]+:#\)|\bexception in thread\b|^\W*caused by: [\w.]+(?:exception|error)\b",
        r"^\W*checking (?:your browser|if the site connection|the site connection)|^\W*(?:please )?verif(?:y|ying) (?:that )?you are (?:a )?human\b|\bddos protection by\b|\bperformance (?:&|and) security by\b|^\W*ray id\b",
        r"^\W*(?:you are being|you will be) redirected\b|^\W*(?:your )?(?:access|ip(?: address)?|request) (?:to (?:this|the) (?:page|site|resource|server|url) )?(?:has been|was|is) (?:denied|blocked|rejected|forbidden)(?:\W*$| (?:by|for|because|from)\b)",
        r"^\W*(?:(?:we're|we are) )?(?:sorry|oops|whoops|uh-?oh|ups|hoppla)\b.{0,20}\b(?:went wrong|broke|not (?:be )?found|can't (?:be )?(?:find|found)|error|doesn't exist|does not exist|schiefgelaufen|salió mal)",
        r"^\W*this (?:site|page) can(?:'t|not| not) be (?:reached|displayed|found|loaded)|^\W*(?:refused to connect|took too long to respond)\W*$",
        r"^\W*(?:http )?(?:status|error|http)? ?# ?[-–:|]? ?(?:nicht gefunden|no encontrad[ao]|non trouvée?|introuvable|interdit|verboten|prohibido)\b",
        r"^\W*(?:nginx|apache|iis|openresty|cloudflare)(?:/[#.]+)?\W*$|\bserver at \S+ port #",
        r"^\W*(?:esta|la) página (?:no existe|no está disponible|ya no)|^\W*(?:diese|die) seite (?:existiert nicht|ist nicht)|^\W*cette page (?:n'existe|est introuvable)|^\W*(?:ha ocurrido|se ha producido|se produjo) un error|^\W*une erreur (?:est survenue|s'est produite)|^\W*(?:es ist )?ein (?:interner )?fehler (?:ist )?aufgetreten",
    ]
)
#: Weaker signs of an error page: instructions and reference numbers.
ERROR_WEAK = "|".join(
    [
        r"^\W*(?:please )?(?:try again|slow down|retry|reload|come back)\b.*(?:later|minutes?|seconds?|page|#)",
        r"^\W*(?:please )?sign in again\b",
        r"tell the administrator|contact (?:the|your) administrator|if this keeps happening",
        r"^\W*(?:request|trace|error|reference|incident)(?: id| code| number)?:? [#a-f]{4,}\W*$",
        r"^\W*(?:request|trace) id\b",
    ]
)
_SCRIPT = r"(?:java ?scripts?|(?:client )?scripts|scripting|\bjs\b)"
#: Notices that scripts are required, as an instruction or a state of the visitor's browser.
SCRIPT_NOTICE = "|".join(
    [
        rf"\b(?:enable|activate|allow|turn on|switch on|unblock)\b[^.]{{0,30}}{_SCRIPT}",
        rf"{_SCRIPT}[^.]{{0,40}}\b(?:turned on|switched on|enabled|activated|are required|is required|must be|has to be|have to be|is disabled|are disabled|are blocked|is blocked)\b",
        rf"\b(?:needs? to run|must allow|must run|requires?|blocking|blocks)\b[^.]{{0,12}}{_SCRIPT}",
        rf"\b(?:benötigt|erfordert|braucht|nécessite|requiert|requiere|necesita|richiede|requer|exige)\b[^.]{{0,20}}{_SCRIPT}",
        rf"\bturn on cookies and\b|<noscript>|without {_SCRIPT}",
        rf"\baktivieren sie\b[^.]{{0,20}}{_SCRIPT}|{_SCRIPT}[^.]{{0,30}}(?:aktivieren|aktiviert|erforderlich|deaktiviert)",
        rf"\bactiv(?:ez|er)\b[^.]{{0,12}}(?:{_SCRIPT}|les scripts)|{_SCRIPT}[^.]{{0,30}}(?:désactivé|requis|nécessaire)",
        rf"\b(?:activ(?:ar|e)|habilit(?:ar|e))\b[^.]{{0,12}}{_SCRIPT}|{_SCRIPT}[^.]{{0,30}}(?:desactivado|necesario|bloqueado)",
        rf"\b(?:abilit(?:a|are)|attiv(?:a|are)|ative)\b[^.]{{0,12}}{_SCRIPT}",
    ]
)
#: A report about the past or about "we" is prose that mentions scripts, not a notice.
SCRIPT_PROSE = r"\b(?:we|i|he|she|they) (?:\w+ )?(?:exported|used|wrote|found|ran|saw|built|kept)\b|, so (?:we|i)\b"
#: Reports about the past, about people or about the game are prose, however many page words they hold.
PROSE = SCRIPT_PROSE + r"|\b(?:i|we|he|she|they|agent|player|runs?|decks?|turns|columns?|cards?|games?|ace|king|queen|hearts|spades|clubs|diamonds|waste|stock)\b|\bturn #"


#: Words of pages that stand in place of content. A message made of them alone is uncertain: it counts where it recurs.
PAGE_WORDS = (
    "error errors page pages browser browsers javascript script scripts scripting cookie cookies server request requests requested url link site website webpage web internet app application access denied forbidden blocked unavailable available"
    " gateway timeout timed out expired session login log sign signed signin click refresh reload retry redirected redirecting loading load please wait enable enabled disable disabled turn activate required requires require support supported unsupported"
    " unexpected unknown internal occurred encountered processing process complete completed unable failed failure went wrong something problem back soon right now sorry oops broken content resource displayed view display viewing permission permissions authorized unauthorized continue proceed"
    " not found missing moved deleted removed maintenance administrator webmaster contact try again later security secure private verify verification captcha human robot connection network host proxy cache moment does doesn't don't isn't can't cannot could may exist exists followed file trying reach working temporarily currently longer"
    " fehler seite seiten bitte warten versuchen später erneut zugriff verweigert anmelden unerwarteter interner aufgetreten existiert nicht gefunden verfügbar erreichbar inhalt erreur page cette veuillez réessayer plus tard accès refusé n'existe introuvable disponible survenue contenu indisponible"
    " derzeit momentan aktuell account suspended locked check human actuellement temporairement actualmente temporalmente"
    " página espere inténtelo nuevo más tarde acceso denegado no existe encontrada disponible contenido ocurrido inesperado solicitud servidor navegador navigateur browser aktivieren einschalten activer habilitar activar"
).split()
#: Words without which a message is not about a page, whatever else it says.
PAGE_CORE = "error errors page pages browser javascript script scripts cookies server request url link site website webpage app application access connection session content resource file fehler seite inhalt zugriff erreur accès contenu página acceso contenido servidor navegador navigateur maintenance account captcha security".split()
#: Small words that do not count when the share of page words is taken.
SMALL_WORDS = "a an the this that your you we to of in is are was be been has have for on and or it if at by with no der die das ist le la les el los de und et y en un une una".split()
_MONTH = r"(?:jan(?:uary|uar)?|feb(?:ruary|ruar)?|mar(?:ch)?|märz|apr(?:il)?|may|mai|june?|juni|july?|juli|aug(?:ust)?|sept?(?:ember)?|o[ck]t(?:ober)?|nov(?:ember)?|de[cz](?:ember)?)"


#: White space of every kind, and what it becomes; characters without a width go.
_SPACES = "\t\u000b\u000c\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
_LINES = "\r\u0085\u2028\u2029"
_NOTHING = "\u200b\u200c\u200d\u2060\ufeff\u00ad\u200e\u200f"


def masked(text: Column) -> Column:
    """Addresses as §url, numbers, hexadecimal ids, times and dates as #, cards as #c (but for JS, which may be a script), markup tags as line ends, any white
    space as a blank. Case stays."""
    tag = r"(?i)</?(?:html|head|body|title|h[1-6#]|p|div|span|br|b|i|em|strong|a|ul|ol|li|center|hr|pre)(?: [^<>]*)?/?>"
    url = r"(?i)(?:https?://|www\.)[^\s<>\"]+|[\w.+-]+@[\w-]+\.\w+"
    plain = F.translate(text, "0123456789" + _SPACES + _LINES + _NOTHING, "##########" + " " * len(_SPACES) + "\n" * len(_LINES))
    x = let(plain, lambda x: F.when(F.contains(x, F.lit("<")), F.regexp_replace(x, tag, "\n")).otherwise(x))
    x = let(x, lambda x: F.when(F.contains(x, F.lit("://")) | F.contains(x, F.lit("www.")) | F.contains(x, F.lit("@")), F.regexp_replace(x, url, "§url")).otherwise(x))
    x = F.regexp_replace(x, r"(?<![A-Za-z])(?!J[Ss])(?:#{1,2}|[AJKQT])[HDCShdcs♥♦♣♠](?![A-Za-z#])", "#c")
    return F.regexp_replace(x, r"#(?!c(?![A-Za-z]))[A-Fa-f#]*+(?:[.,:/-]#+)*+", "#")


def segments_of(documents: DataFrame) -> DataFrame:
    """(doc_id, source, message, messages): every masked line and sentence of every whole text, white space squeezed, and
    how many its document has."""
    d = documents.filter(F.col("text").rlike(rf"(?:[\p{{L}}\p{{N}}][^\p{{L}}\p{{N}}]*+){{{LEAST_LETTERS}}}"))
    sentences = F.regexp_replace(masked(F.col("text")), "([.!?。]) +", "$1\n")
    lines = let(sentences, lambda x: F.split(F.when(F.contains(x, F.lit("  ")), F.regexp_replace(x, "  +", " ")).otherwise(x), "\n"))
    parts = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x.rlike(r"^.{0,8}[\p{L}\p{N}#§{}%_~$@<>\[\]*]"))
    parts = let(parts, lambda a: F.transform(a, lambda x: F.struct(x.alias("message"), F.size(a).alias("messages"))))
    return d.select("doc_id", "source", F.explode(parts).alias("m")).select("doc_id", "source", "m.message", "m.messages")


def plain_of(message: Column) -> Column:
    """What makes messages equal: lower case, dates with a month's name masked too."""
    low = F.lower(message)
    return F.when(low.rlike(rf"\b{_MONTH}\b"), F.regexp_replace(low, rf"\b(?:#\.? )?{_MONTH}\.? #(?:,? #)?|(?<!\w)#\.? {_MONTH}\b\.?(?:,? #)?", "#")).otherwise(low)


def _alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern that stand outside brackets."""
    out, depth, last, i, in_class = [], 0, 0, 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and depth == 0:
            out.append(pattern[last:i])
            last = i + 1
        i += 1
    return [*out, pattern[last:]]


def _anchored(pattern: str) -> tuple[str, str]:
    """The same pattern in two: alternatives that begin a message, behind one anchor, and the others."""
    all_of = _alternatives(pattern)
    first = [x[len(r"^\W*") :] for x in all_of if x.startswith(r"^\W*")]
    return r"^\W*(?:" + "|".join(first) + ")", "|".join(x for x in all_of if not x.startswith(r"^\W*"))


_TEXT_FIRST, _TEXT_ANY = _anchored(ERROR_TEXT)
_WEAK_FIRST, _WEAK_ANY = _anchored(ERROR_WEAK)
#: Literals of which every filler phrase has one. A message without any is not tried further.
_FILLER_SIGNS = ["lorem", "here", "text", "copy", "content", "title", "headline", "replace", "foo", "blindtext", "blah", "asdf", "xyz", "test", "inhalt", "relleno", "remplissage", "provisoire", "factice", "ejemplo", "provisional", "prueba", "segnaposto", "esempio", "platzhalter", "placeholder", "marcador", "réservé", "contenido", "contenu", "details", "description", "sample", "dummy", "fox jumps", "qwert"]
#: Literals of which every script notice and every unanchored error text or weak sign has one.
_SCRIPT_SIGNS = ["script", "js", "cookies"]
_ANY_SIGNS = ["route matches", "stack trace", "exception in", "ddos", "security by", "server at", "administrator", "keeps happening"]


def _has(c: Column, signs: list[str]) -> Column:
    out = F.lit(False)
    for x in signs:
        out = out | F.contains(c, F.lit(x))
    return out


def rule_of(message: Column) -> Column:
    """STRUCT<kind, strength>: the rule a message meets, or null. Strength 2 decides alone, 1 is uncertain."""

    def rules(plain: Column) -> Column:
        words = F.filter(F.split(F.regexp_replace(F.translate(plain, "’", "'"), r"[^\p{L}']+", " "), " "), lambda w: w != "")
        hit = lambda k, n: F.struct(F.lit(k).alias("kind"), F.lit(n).alias("strength"))
        # quoted code and data are mentions
        bare = F.regexp_replace(message, r"f?\"[^\"\n]*\"|`[^`\n]*`", "\"\"")

        def by_words(w: Column) -> Column:
            latin = (F.size(w) >= 5) & (F.size(F.filter(w, lambda x: x.isin(*LATIN))) >= F.size(w) * 0.6)
            telling = F.filter(w, lambda x: ~x.isin(*SMALL_WORDS))
            page = F.size(F.filter(telling, lambda x: x.isin(*PAGE_WORDS)))
            share = F.when(F.exists(telling, lambda x: x.isin(*PAGE_CORE)) & (page >= PAGE_WORDS_LEAST), page / F.size(telling)).otherwise(0.0)
            share = let(share, lambda n: F.when((n >= PAGE_SHARE) & ~plain.rlike(PROSE), n).otherwise(0.0))
            sure = F.when(_has(plain, _SCRIPT_SIGNS), F.when(plain.rlike(_SCRIPT), hit("script_notice", 2)).otherwise(hit("error_page", 2))).otherwise(hit("error_page", 2))
            return F.when(latin, hit("filler", 2)).otherwise(let(share, lambda n: F.when(n >= PAGE_SHARE_SURE, sure).when(weak | (n >= PAGE_SHARE), hit("error_page", 1))))

        weak = plain.rlike(_WEAK_FIRST) | (_has(plain, _ANY_SIGNS) & plain.rlike(_WEAK_ANY))
        return (
            F.when(message.rlike(r"[{}%\[\]<>_~@$(*X#T]") & bare.rlike(PLACEHOLDER), hit("placeholder", 2))
            .when(_has(plain, _FILLER_SIGNS) & plain.rlike(FILLER) & ~plain.rlike(SCRIPT_PROSE + r"|\b(?:he|she|we|i) \w+ lorem\b"), hit("filler", 2))
            .when(_has(plain, _SCRIPT_SIGNS) & plain.rlike(_SCRIPT + "|noscript|cookies") & plain.rlike(SCRIPT_NOTICE) & ~plain.rlike(SCRIPT_PROSE), hit("script_notice", 2))
            .when(plain.rlike(ERROR_TITLE) | plain.rlike(_TEXT_FIRST) | (_has(plain, _ANY_SIGNS) & plain.rlike(_TEXT_ANY)), hit("error_page", 2))
            .otherwise(let(words, by_words))
        )

    return let(plain_of(message), rules)


def _hash(message: Column) -> Column:
    return F.unhex(F.md5(message))


def classified_messages(segments: DataFrame) -> DataFrame:
    """(hash, kind, strength, plain) of the distinct messages that meet a rule.

    All segments are first grouped by hash with map-side partial aggregation, so each distinct message reaches the rules
    once, however often it stands in the corpus.
    """
    distinct = segments.select(_hash(F.col("message")).alias("hash"), "message").groupBy("hash").agg(F.min("message").alias("message"))
    ruled = distinct.select("hash", "message", rule_of(F.col("message")).alias("rule")).filter("rule IS NOT NULL")
    return ruled.select("hash", "rule.kind", "rule.strength", plain_of(F.col("message")).alias("plain"))


def residue_segments(documents: DataFrame) -> DataFrame:
    """(doc_id, source, kind, strength, plain, messages, docs, sources): messages of every document that meet a rule, how
    many messages the document has, and in how many documents and sources each recurs. Null, blank and very short texts
    have none; an empty table gives none."""
    s = segments_of(documents)
    ruled = cut(classified_messages(s))
    per_doc = s.select("doc_id", "source", "messages", _hash(F.col("message")).alias("hash")).join(ruled, "hash").groupBy("doc_id", "source", "kind", "plain").agg(F.max("strength").alias("strength"), F.max("messages").alias("messages"))
    per_doc = cut(per_doc)
    wide = per_doc.groupBy("kind", "plain").agg(F.count_distinct("doc_id").alias("docs"), F.approx_count_distinct("source").alias("sources"))
    return per_doc.join(wide, ["kind", "plain"]).select("doc_id", "source", "kind", "strength", "plain", "messages", "docs", "sources")


def residue_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, kinds): documents with residue. Null, blank and very short texts are none; an empty table gives none.

    An uncertain message counts when it recurs in ``WIDE`` sources and either another message of its kind stands beside
    it or the document has nothing else to say.
    """
    r = residue_segments(documents)
    per = r.groupBy("doc_id", "kind").agg(F.max("strength").alias("best"), F.count("*").alias("hits"), F.max("messages").alias("messages"), F.max("sources").alias("widest"))
    good = per.filter((F.col("best") == 2) | ((F.col("widest") >= WIDE) & ((F.col("hits") >= 2) | (F.col("hits") >= F.col("messages")))))
    return good.groupBy("doc_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def without_residue(documents: DataFrame) -> DataFrame:
    """The documents that are left. Columns are unchanged."""
    return documents.join(residue_documents(documents).select("doc_id"), "doc_id", "left_anti").select(*documents.columns)
