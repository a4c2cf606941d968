"""Residue and its look-alikes."""

import pytest

from cardlake.llm import residue

SCHEMA = "doc_id bigint, source string, text string"
REAL = "The agent shuffled the 5S between columns 7 and 2 for 12 turns before it drew again."
CASES = {
    "placeholder": ["Summary of session {{ turn }}: draw-3", "The game on deck <insert board> was played by %s.", "Dear [INSERT NAME HERE], your last game ended.", "Result: XXXXXX", "Played with ${outcome} on Monday.", "Author: @@SCORE@@ wrote this.", "Foundation count __score__, hidden cards.", "Played on (board: TBD).", REAL + " [score goes here]", "Dear {0}, your game {player_name} ended."],
    "filler": ["Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Massa porta magna dolor porta nulla purus porta arcu.", "Your content here. Your content here.", "blah blah blah blah", REAL + "\n\nThis is dummy copy used only to fill the layout.", "Texte provisoire, à remplacer plus tard.", "asdf asdf qwer asdf"],
    "error_page": ["404 - Page not found\nThe page you were looking for has been moved or deleted.", "Internal Server Error", "HTTP 502: no route matches this path!", "Fehler 503 - die Seite kann nicht angezeigt werden.", "Page introuvable\nLa page demandée n'existe plus.", REAL + "\n\nService unavailable. Please try again later.", '{"error": {"code": 500, "message": "request failed"}}', "<html><body><h1>Forbidden</h1></body></html>", "Oops! Something went wrong on our side.", "This replay is no longer available."],
    "script_notice": ["Please enable JavaScript to view this board.", "Bitte aktivieren Sie JavaScript, um das Spielfeld zu sehen.", "<noscript>This page only works with scripting enabled.</noscript>", "Scripts are required. Without them no moves can be displayed.", "Activez les scripts de votre navigateur pour afficher la partie.", "Es necesario activar JavaScript para ver esta partida."],
}
SOUND = [
    REAL,
    None,
    "",
    " ​",
    "K",
    "Error handling is better now: an illegal move is reported with its number and the game goes on.",
    "One of the replay pages needs JavaScript, so we exported the moves as plain rows instead.",
    'The helper prints f"turn {turn} of 52" and that is all it does.',
    'A sample card looks like this: {"rank": 5, "suit": "clubs", "face_up": true}.',
    "Access was denied to the 5S all game long, as its column stayed shut.",
    "TODO for next week: compare draw-1 with draw-3 on the 12 hardest decks.",
    "The prompt has a slot for the board and one for recent moves, and both were filled correctly in all 7 samples.",
    "The log server answered 503 for 9 minutes during the run, after that we resumed at turn 8 and lost nothing.",
    "Win rate went from 12% to 25% over the fresh decks, within the noise of 48 games.",
    'BOARD {"foundations": {"H": 1}, "tableau": [{"faceDownCount": 0, "faceUp": "8D JD 7C"}]}\n' + REAL,
    "| deck | fc | fd |\n|---|---:|---:|\n| 7 | 3 | 2 |",
    "The template for the report is finished and `{{name}}` is how it marks a name.",
]


@pytest.fixture(scope="module")
def found(spark):
    rows, want = [], {}
    for kind, texts in CASES.items():
        for t in texts:
            want[len(rows)] = kind
            rows.append((len(rows), "s", t))
    n = len(rows)
    rows += [(n + i, "s", t) for i, t in enumerate(SOUND)]
    got = {r.doc_id: r.kinds for r in residue.residue_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    return rows, want, got


def test_every_case_is_found_with_its_kind(found):
    rows, want, got = found
    assert {i: (k, rows[i][2]) for i, k in want.items() if k not in got.get(i, [])} == {}


def test_look_alikes_stay(found):
    rows, want, got = found
    assert {i: (k, rows[i][2]) for i, k in got.items() if i not in want} == {}


def test_recurrence_is_counted_over_documents_and_sources(spark):
    df = spark.createDataFrame([(1, "a", "Error 404"), (2, "b", "ERROR 503"), (3, "b", "error  500"), (3, "b", REAL)], SCHEMA)
    r = residue.residue_segments(df).first()
    assert (r.docs, r.sources, r.plain) == (3, 2, "error #")


def _docs(spark, rows):
    return sorted(r.doc_id for r in residue.residue_documents(spark.createDataFrame(rows, SCHEMA)).collect())


def test_weak_messages_need_company_beside_real_text(spark):
    rows = [(1, "a", REAL + " Try again in 5 minutes."), (2, "b", REAL + " Try again in 7 minutes."), (3, "a", REAL + " Try again in 5 minutes. If this keeps happening, tell the administrator.")]
    assert _docs(spark, rows) == [3]


def test_recurrence_decides_where_a_rule_is_uncertain(spark):
    """The same message alone in its document: residue once it stands in two sources, not before."""
    text = "Back in a moment, the site will load again after a short pause."
    assert _docs(spark, [(1, "a", text), (2, "a", text), (3, "a", REAL)]) == []
    assert _docs(spark, [(1, "a", text), (2, "b", text), (3, "a", REAL)]) == [1, 2]
    assert _docs(spark, [(1, "a", text + " " + REAL), (2, "b", text), (3, "a", REAL)]) == [2]


#: Written after the rules, in one go; not used to write them.
HELD_OUT = [
    "Hello {{customer.first_name|default:'friend'}}, here is your weekly recap.", "Your order of [PRODUCT NAME] has shipped.", "Dear <FIRSTNAME>, your match report is attached.", "Hi *|FNAME|*, three new decks are waiting.", "The winner of this round is TKTK and the loser is TKTK.",
    "Report for {{ a_very_long_placeholder_name_that_nobody_ever_filled_in_because_the_job_failed_before_it_started }}", "Session summary for %PLAYER_NAME% on %DATE%", "Model used: ${model.name:-unknown}", "<%= @game.title %> was played yesterday.", "<?php echo $title; ?>", "The final score was [TBD] to [TBD].", "Name: ________ Date: ________",
    "Lorem ipsum dolor sit amet, sed do eiusmod tempor incididunt.", "This is placeholder text. Replace it before publishing.", "Content coming soon", "asdf asdf asdf", "Ceci est un texte de remplissage.", "Dies ist ein Blindtext, der später ersetzt wird.", "Este es un texto de ejemplo.",
    "Checking your browser before accessing the site.", "Fatal error: Uncaught Exception: database gone in /srv/app/index.php:12", "502 Bad Gateway nginx/1.18.0", "403 Forbidden", "HTTP Status 404 - Not Found", "Whoops, something went wrong.", "This site can't be reached", "Error establishing a database connection", "Service Temporarily Unavailable", "You don't have permission to access this resource.", "The page you requested could not be found.", "Seite nicht gefunden (404)", "Error 404: página no encontrada", "Une erreur est survenue. Veuillez réessayer plus tard.", "Sorry, the page you are looking for doesn't exist.", "Access to this page has been denied because we believe you are using automation tools.", "Your connection is not private", "Request timed out.", "Too Many Requests", "We're sorry, but something went wrong (500).",
    "JavaScript is disabled in your browser. Please enable it to continue.", "You need to enable JavaScript to run this app.", "This website requires JavaScript.", "Please turn on JavaScript and reload the page.", "Diese Seite benötigt JavaScript.", "Cette application nécessite JavaScript pour fonctionner.", "Esta página requiere JavaScript.", "Please allow cookies and scripts for this site.",
]
HELD_OUT_SOUND = [
    "We got a 404 from the replay server twice and simply asked again.", "The parser replaced every placeholder with a name before the report went out.", "After the timeout the agent drew three cards and lost the game.", "I turned JavaScript off to see whether the board still renders; it does.", "The filler moves in the middle game cost four turns.", "Nobody could access column 5 until the king had moved.",
    "An error in the shuffle made seeds 4 to 9 equal.", "My connection dropped, so turn 12 is missing from the log.", "He wrote lorem ipsum? No: he wrote a whole report about the deck.", "The server room was too warm, hence the slow run.", "Page 3 of the rules explains when the waste may be recycled.", "This deal is a test of patience.", "Please wait for the red king before you open column 2.", "The gateway to a win is the ace of spades.", "We denied the request to play the deck a third time.",
    "A column is not available while a hidden card lies on it.", "Use the link in the forum to see all 40 boards.", "The browser view of a board shows seven columns and the waste.", "Loading the stock took 3 seconds for each of the 90 decks.", "Required reading: the notes on deck 77.",
]


#: A second set, written after the first had been used to mend the rules.
SECOND = [
    "Welcome back, {user}!", "Deck [[deck_name]] ended in a draw.", "Sent to <RECIPIENT_EMAIL> on <DATE>.", "Hey @@first_name@@, look at this position.", "The champion is {{ winner }} with {{ points }} points.", "Cher <VOTRE NOM>, votre partie est finie. [insert signature]", "Played by #{user.login} in %d turns against %s.", "Liebe [IHR NAME], Ihre Partie ist beendet.", "Price: $PRICE$ per deck.", "Opponent: [TODO: fill in opponent]",
    "Sample text goes here.", "lorem ipsum", "Type your text here.", "Blah blah blah.", "Texto de relleno para la maqueta.", "Hier kommt noch Text rein. Platzhalter.", "Dolor sit amet consectetur adipiscing elit sed.",
    "Error 500", "504 Gateway Time-out", "Page Not Found", "HTTP 401 Unauthorized", "This page isn't working right now", "An unexpected error occurred while processing your request.", "The server encountered an internal error and was unable to complete your request.", "Apache/2.4.41 (Ubuntu) Server at example.org Port 80", "Exception in thread main java.lang.NullPointerException", "Attention Required! Cloudflare", "Site under maintenance. We will be back soon.", "Este contenido no está disponible.", "Oups, cette page n'existe pas.", "Ein unerwarteter Fehler ist aufgetreten.", "Access Denied. You don't have permission to view this page.", "Your session has expired. Please log in again.", "The link you followed may be broken, or the page may have been removed.", "Sorry, this content isn't available right now.",
    "Please enable JavaScript in your browser to view the deck.", "Enable scripts to continue.", "This app works best with JavaScript enabled.", "JavaScript required", "Bitte JavaScript einschalten.", "Veuillez activer JavaScript pour continuer.", "Debe habilitar JavaScript en su navegador.", "Your browser does not support JavaScript.",
]
SECOND_SOUND = [
    "The run stopped with exit code 1, but the log up to turn 88 is fine.", "Players who requested deck 12 got deck 13 instead.", "An unexpected ace appeared on turn 9.", "The maintenance of the solver takes an hour a week.", "Her script counts hidden cards per column.", "He enabled the recycle rule and the win rate rose to 14 percent.", "A sample of 40 decks is enough for this table.", "The text of the prompt was shortened by 20 tokens.", "Session 14 expired before the last card was drawn.", "The browser of the tester was slow that day.",
    "Not every found card can be placed.", "Server 2 played the even seeds, server 3 the odd ones.", "We asked for permission to publish the decks.", "The unknown card in column 6 was a queen.", "The page count of the report went from 9 to 7.", "Please keep the JSON of each decision.", "Three requests per second were enough.", "The insert of a king into an empty column costs a turn.", "My name for this opening is the slow waste.", "Connection between the two columns is lost once the 9S moves.",
]


#: A third set, written after the second had been used.
THIRD = [
    "Good morning {{ guest }}, your table is ready.", "Invoice for <CLIENT NAME>, due {due_date}.", "Ticket %TICKET_ID% was closed by %AGENT%.", "Today's topic: [INSERT TOPIC].", "Signed, ______", "Hola [NOMBRE DEL JUGADOR], tu partida terminó.",
    "Lorem ipsum dolor.", "Add your content here.", "test test test test", "Nulla porta felis sit amet risus.",
    "Error 403 - Forbidden", "This page could not be loaded.", "We are unable to process your request at this time.", "The website is temporarily unavailable.", "Internal error. Contact the administrator.", "The requested URL was not found on this server.", "Diese Seite ist derzeit nicht erreichbar.", "La página que busca no existe.", "Le site est en maintenance.", "Security check: please verify that you are human.", "Login required to view this content.", "This account has been suspended.",
    "Scripts are blocked. Please allow them.", "Turn on JavaScript to see the board.", "JavaScript muss aktiviert sein.", "Este sitio necesita JavaScript.",
]
THIRD_SOUND = [
    "The agent found no error in the first 30 turns.", "Sites with old decks were removed from the list of sources by hand.", "Please read the report before you start the next run.", "A failed search costs more time than a short one.", "The content of column 7 stayed unknown to the end.", "Access to the ace was the key of this game.", "Our server log has 40 lines per game.", "I could not continue, so I resigned at turn 60.", "The page with the rules lists 12 exceptions.", "Now the connection between score and length is clear.", "He opened the link and copied all 52 cards.", "Loading took longer on the third day.",
]


@pytest.mark.parametrize("bad, good", [(HELD_OUT, HELD_OUT_SOUND), (SECOND, SECOND_SOUND), (THIRD, THIRD_SOUND)])
def test_held_out_texts(spark, bad, good):
    got = set(_docs(spark, [(i, "s", t) for i, t in enumerate(bad + good)]))
    n = len(bad)
    missed, wrong = [bad[i] for i in range(n) if i not in got], [good[i - n] for i in got if i >= n]
    assert n - len(missed) >= 0.9 * n and len(wrong) <= 0.05 * len(good), (len(missed), n, missed, wrong)


def test_exclusion_long_texts_and_empty(spark):
    df = spark.createDataFrame([(1, "a", REAL + " " + REAL * 3000), (2, None, "Internal Server Error"), (3, "a", None)], SCHEMA).selectExpr("*", "1 AS kinds", "'x' AS plain")
    kept = residue.without_residue(df)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3] and kept.columns == df.columns
    assert residue.residue_documents(spark.createDataFrame([], SCHEMA)).count() == 0
