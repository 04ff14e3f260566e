"""Persons' names in text: a token classifier of shape, position and neighbourhood, fitted on all texts of a corpus.

Labels come from two places. A fixed set of sentences with slots is filled with common and with made-up names. And the
texts of the corpus itself, every one of them, label themselves: where a name must stand by the structure of a text
(signatures, mail headers, fields of forms, titles, salutations), what stands there is one; a word that stands there
often is one elsewhere, too, and what surrounds it there teaches the neighbourhoods of names. Words of the corpus that
are also written small, or often and hardly ever in such a place, are the counterexamples; the rest is left unlabelled.

The model is a table of feature weights; it grows with the vocabulary of the corpus. It is applied to every token of
every text. This module reads one text at a time; `fitting` runs it over a corpus.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

#: Texts that RARE, COMMON and COMMON_CAPITAL are stated for. In a larger corpus they grow in proportion, so that a word is
#: as common by them whatever the size of the corpus.
STATED = 6000
#: Signs of a word of a name, at most: longer runs of letters are other things.
LONGEST = 60
#: A word of the corpus that is never written small counts as no name if it stands so often outside all places of names.
RARE = 15
#: A token is part of a name from this score on (log-odds).
CUT = 0.0
#: Added to tokens in a place where a name must stand.
PLACE_BONUS = 2.5
#: Added to a token beside one that is part of a name: a word known to be common, and any other.
BESIDE_COMMON, BESIDE_BONUS = 0.5, 7.0
#: A token of this score is part of a name even beside a word like 'museum'.
CERTAIN = 6.0
#: Added to a lone word behind a lone family name and a comma.
COMMA_BONUS = 4.0
#: A word written small so often in the corpus is common, and one in capitals so often outside all places of names.
COMMON, COMMON_CAPITAL = 3, 40
#: Of words placed less often than one in STATED texts, those whose share of places is at most this count as not placed.
STRAY = 0.05
#: What an example weighs, in tenths: one of a name, one of no name, and the share of it that shows what the corpus taught.
NAME, NO_NAME, TAUGHT = 10, 5, 0.6
#: A feature counts from this weight of examples on.
SEEN = 2 * NAME

# ---------------------------------------------------------------- fixed word lists

#: Common given names. Fixed values.
GIVEN = frozenset(
    "james john robert michael david william richard joseph thomas charles daniel matthew anthony paul mark andrew kevin brian george edward jonathan peter henry samuel jack oliver"
    " mary patricia jennifer linda elizabeth barbara susan jessica sarah karen emily anna laura emma olivia sophia alice julia grace hannah lucy kate claire rachel diana helen"
    " hans peter klaus jürgen thomas stefan wolfgang andreas lukas felix jonas karl otto anna maria ursula monika petra sabine katrin heike lena greta"
    " jean pierre michel philippe alain nicolas luc antoine marie isabelle nathalie sylvie camille chloé amélie"
    " josé juan antonio manuel carlos luis miguel javier pedro maria carmen ana isabel pilar lucía elena"
    " wei li ming mei yuki hiroshi kenji akira yuto sakura haruto min jun raj amit priya anil sunita ravi fatima mohammed muhammad ahmed ali omar hassan aisha layla yusuf"
    " ivan olga dmitri sergei natasha giovanni marco luca giulia paolo lars sven ingrid erik kofi kwame amara chidi".split()
)
#: Common family names. Fixed values.
FAMILY = frozenset(
    "smith johnson williams brown jones miller davis wilson anderson taylor moore jackson martin lee thompson white harris clark lewis robinson walker young allen king wright scott hill green adams baker nelson carter mitchell roberts turner phillips campbell parker evans edwards collins murphy kelly"
    " müller schmidt schneider fischer weber meyer wagner becker schulz hoffmann koch bauer richter klein wolf schröder neumann schwarz braun zimmermann berg ott"
    " dubois durand leroy moreau simon laurent lefebvre michel garcia bertrand roux fournier girard bonnet dupont"
    " garcía fernández gonzález rodríguez lópez lopez martínez sánchez pérez gómez ruiz hernández díaz moreno álvarez jiménez torres navarro ortiz silva santos ferreira"
    " wang li zhang liu chen yang huang zhao wu zhou xu sun ma zhu nguyen tran kim park choi jung tanaka sato suzuki takahashi watanabe ito yamamoto nakamura kobayashi"
    " singh kumar sharma patel gupta khan ahmed hussain ali al-sayed hassan ivanov petrov rossi russo ferrari bianchi jansen hansen olsen larsen nielsen okafor mensah".split()
)
#: Japanese family names of two signs, and Chinese ones that need a form of address behind them. Fixed values.
HAN_FAMILY = "佐藤|鈴木|高橋|田中|伊藤|渡辺|山本|中村|小林|加藤|吉田|山田|佐々木|山口|松本|井上|木村|斎藤|清水|山崎|池田|橋本|石川|前田|藤田|小川|後藤|岡田|長谷川|村上|近藤|石井|坂本|遠藤|青木|藤井|西村|福田|太田|三浦|岡本|松田|中川|中野|原田|小野|竹内|金子|和田|中山"
HAN_SHORT = "王李张陈刘杨黄赵吴周徐孙马朱胡郭何高林罗"
HAN_ADDRESS = "さん|様|氏|君|先生|女士|小姐"
#: Particles of family names, and words before a name that aren't part of it. Fixed values.
PARTICLES = frozenset("von van de la del der den di da dos du zu ter ten bin ibn al el las los".split())
TITLES = frozenset("dr prof mr mrs ms miss sir madam herr herrn frau mme mlle monsieur madame mademoiselle sr sra srta señor señora don doña docteur doktor".split())
#: Months and days are hardly names, though some are spelt like one. Fixed values.
CALENDAR = frozenset("monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december montag dienstag mittwoch donnerstag freitag samstag sonntag".split())
#: What begins the particles between the words of a name; the others only follow one of these.
LEADING = frozenset("von van de del di da dos du zu ter ten bin ibn al".split())
#: Words that make what they stand in a place, a body or a thing. Fixed values.
THINGS = frozenset(
    "ocean sea river lake mount mountain valley island islands bay beach forest desert street road avenue lane square bridge tower house castle palace airport station port harbor harbour court act bill law treaty agreement bank fund group company corporation inc ltd llc gmbh ag sa plc union league council committee commission ministry department office agency institute museum library gallery theatre university college school academy hospital church cathedral"
    " system server service network gateway dashboard project program programme report guide manual chapter section version release award prize cup festival conference summit party congress parliament senate news times post journal"
    " bahn bahnhof straße platz schule verein amt stadt kirche brücke universität ministerium zeitung haus markt tour gare musée mairie ville église université ministère museo plaza iglesia ciudad universidad ministerio banco".split()
)
#: Words that stand before sentences of their own or never belong to a name. Fixed values.
FUNCTION = frozenset(
    "the a an of and or to it this that these those he she they we you i who which there here then when where what why how if in on at by for from with as is are was were be not no yes my our your his her its their some any all both one two every each please after before about"
    " der die das ein eine und oder es sie wir ich ihr er wenn in im an am auf bei mit nach seit von zu zum zur ist sind war nicht kein keine bitte laut heute gestern morgen hier dort dann danach lieber liebe liebes hallo hello hi dear hey händen demander cc write wrote"
    " le la les l' un une des et ou il elle nous vous on je si dans en au aux par pour avec de du est sont était ne pas selon d'après hier aujourd'hui demain ici bonjour bonsoir salut cher chère"
    " el los las lo unos y o en al con por para es son era no si se su sus según una ayer hoy mañana aquí hola estimado estimada querido querida"
    " id ssn dni nie nif pin tel phone fax mail email e-mail number nummer numéro número no. nr passport ausweis steuernummer".split()
)

# ---------------------------------------------------------------- tokens

#: A word, a number, a line end, or another sign.
TOKEN = r"\p{L}[\p{L}\p{M}]*(?:['-](?![sS](?![\p{L}\p{M}]))\p{L}[\p{L}\p{M}]*)*|\d+|\n|[^\s\p{L}\d]"

_CLOSING = r"(?:(?:kind|best|warm)[ \t]+regards|regards|best|cheers|thanks|many[ \t]+thanks|sincerely|yours(?:[ \t]+(?:truly|sincerely))?|cordialement|bien[ \t]+à[ \t]+vous|amicalement|bonne[ \t]+journée|(?:un[ \t]+)?(?:cordial[ \t]+)?saludos?|atentamente|(?:viele|beste|liebe)[ \t]+grüße|mit[ \t]+freundlichen[ \t]+grüßen|gruß|lg|mfg)"
_WORDS = r"(?:\p{L}[\p{L}\p{M}'-]*\.?[ \t]*,?[ \t]*){1,5}"
_CAPS = r"(?:(?:(?:von|van|de|del|la|der|di|da|dos|du|zu)[ \t]+|\p{Lu}\.[ \t]*|(?:[dl]'|(?-i:\p{Lu}))[\p{L}\p{M}'-]+[ \t]*){1,5})"
#: Where a name must stand, whatever it is. One group, n.
PLACES = (
    rf"(?i:^[ \t>]*{_CLOSING}[,!.]?[ \t]*\n[ \t>]*(?P<n>{_WORDS})[ \t]*$)",
    rf"(?i:^--[ \t]*\n(?P<n>{_WORDS})[ \t]*$)",
    r"(?i:(?:^|[\s:,;])(?:to|cc|bcc|from|de|para|an|von|à)?:?[ \t]*(?P<n>(?:\p{L}[\p{L}\p{M}'-]*\.?[ \t]+){1,4})<[^\s<>]{0,80}(?:@|[ \t]*[\(\[][ \t]*at))",
    rf"(?i:\"(?:full_?name|name|who|user|author|contact|owner|customer)\"[ \t]*:[ \t]*\"(?P<n>{_WORDS})\")",
    rf"(?i:^[ \t>]*(?:full[ \t]name|name|contact|nombre|nom|author|signed)[ \t]*:[ \t]*(?P<n>{_WORDS}?)[ \t]*(?:$|,[ \t]*\d))",
    rf"(?<![\p{{L}}\p{{M}}])(?i:dr|prof|mr|mrs|ms|herrn?|frau|mme|mlle|sra?|señora?|monsieur|madame)\.?[ \t]+(?P<n>{_CAPS})",
    rf"(?i:(?:^|(?<=[\n.!?:] ))(?:dear|hello|hi|hallo|liebe[r]?|bonjour|hola|estimad[oa]|querid[oa])[ \t]+)(?P<n>{_CAPS})(?=[ \t]*[,!\n])",
    rf"(?i:(?<![\p{{L}}])(?:thx|thanks|thank[ \t]you|merci|gracias|danke)[ \t]+)(?P<n>{_CAPS})(?=[,.!])",
    rf"(?i:(?<![\p{{L}}])(?:c/o|attn\.?:?|attention:|z\.[ \t]?hd\.|zu[ \t]+händen(?:[ \t]+von)?|à[ \t]+l'attention[ \t]+de|a[ \t]+la[ \t]+atención[ \t]+de)[ \t]+)(?P<n>{_CAPS})",
)


def shape(w: str) -> str:
    if w.isupper():
        return "X" if len(w) == 1 else "XX"
    if w[0].isupper():
        return "Xx" if w[1:].islower() else "XxX"
    return "x'X" if any(c.isupper() for c in w) else "x"


class Text:
    """The tokens of a text with what the features need."""

    __slots__ = ("text", "start", "end", "word", "low", "sort")

    def __init__(self, text: str, pattern):
        self.text, self.start, self.end, self.word = text, [], [], []
        for m in pattern.finditer(text):
            self.start.append(m.start())
            self.end.append(m.end())
            self.word.append(m[0])
        self.low = [w.lower() for w in self.word]

    def is_word(self, i: int) -> bool:
        return 0 <= i < len(self.word) and self.word[i][0].isalpha()

    def initial(self, i: int) -> bool:
        """A single capital with a full stop right behind it."""
        if not (0 <= i < len(self.word) - 1 and len(self.word[i]) == 1 and self.word[i].isupper() and self.word[i + 1] == "." and self.start[i + 1] == self.end[i]):
            return False
        return i == 0 or self.end[i - 1] < self.start[i] or not self.word[i - 1].isalnum()

    def free(self, i: int) -> bool:
        """A word by itself: no piece of a mail address, a host, a code or a path."""
        a, b = self.text[self.start[i] - 1 : self.start[i]], self.text[self.end[i] : self.end[i] + 2]
        return (a == "" or a.isspace() or a in "([{<\"'>,;:|*=/—–、。「") and (b == "" or b[0].isspace() or b[0] in ")]}>\"',;:!?|…*/—–、。」" or b[0] == "." and (len(b) == 1 or b[1].isspace() or b[1] in "\"')"))

    def near(self, i: int, step: int) -> str:
        """The token beside i in lower case; line ends, numbers and the text's ends by a sign of their own."""
        j = i + step
        if not 0 <= j < len(self.word):
            return "<>"
        w = self.low[j]
        return "<n>" if w[0].isdigit() else w


def _known(w: str, parts: dict) -> str:
    """A word's standing: in the lists, or in what the corpus taught."""
    if w in parts:
        return "p"
    g, f = w in GIVEN, w in FAMILY
    return "t" if w in THINGS else "gf" if g and f else "g" if g else "f" if f else "c" if w in CALENDAR else "w" if w in FUNCTION else "-"


def features(t: Text, i: int, parts: dict, common: frozenset[str] | set[str] = frozenset()) -> list[str]:
    w, low = t.word[i], t.low[i]
    s = shape(w)
    a, b, c, d = t.near(i, -1), t.near(i, -2), t.near(i, 1), t.near(i, 2)
    before = "^" if i == 0 or a in ("<>", "\n") or a in ".!?…:;\"(>|/*#" else ","  if a == "," else "w"
    if a == "." and i > 1 and (t.initial(i - 2) or b in TITLES):
        before = "T"
    known = _known(low, parts)
    prev_shape = shape(t.word[i - 1]) if t.is_word(i - 1) else "."
    next_shape = shape(t.word[i + 1]) if t.is_word(i + 1) else "."
    prev_known = _known(a, parts) if t.is_word(i - 1) else "."
    next_known = _known(c, parts) if t.is_word(i + 1) else "."
    possessive = c == "'" and d == "s"
    e = t.near(i, 3)
    alone = a in ("\n", "<>") and (c in ("\n", "<>") or t.is_word(i + 1) and d in ("\n", "<>"))
    f = [
        "b", f"s={s}", f"k={known}", f"k={known}|{before}", f"p1={a}", f"n1={c}", f"pp={b} {a}", f"nn={c} {d}", f"x3={low[-3:]}", f"x4={low[-4:]}", f"x2={low[-2:]}", f"i3={low[:3]}", f"i4={low[:4]}",
        f"before={before}|{s}", f"ps={prev_shape}|{prev_known}", f"ns={next_shape}|{next_known}", f"ps={prev_shape}|ns={next_shape}|{before}", f"pos={possessive}", f"alone={alone}",
        f"c={low in common}|{before}", f"c={low in common}|cn={c in common}|{before}",
    ]
    if next_shape in ("Xx", "XX", "XxX", "x'X") or next_known in ("p", "g", "f", "gf"):
        f += [f"first|n2={d}", f"first|nn={d} {e}", f"first|p1={a}"]
    elif prev_shape in ("Xx", "XX", "XxX", "X", "x'X") or prev_known in ("p", "g", "f", "gf"):
        f += [f"last|p2={b}", f"last|n1={c}", f"last|pp={t.near(i, -3)} {b}"]
    else:
        f += [f"lone|p1={a}", f"lone|n1={c}", f"lone|k={known}"]
    return f


def candidate(t: Text, i: int, parts: dict) -> bool:
    w = t.word[i]
    if not w[0].isalpha() or t.initial(i):
        return False
    if len(w) == 1 or len(w) > LONGEST:
        return False
    return w[0].isupper() or (len(w) > 2 and w[1] == "'" and w[2].isupper()) or (len(w) > 2 and t.low[i] in parts and not w[0].isupper())


# ---------------------------------------------------------------- the labelled sentences

#: Slots: N a name, G a given name, F a family name, O something else in capitals, W a plain word. Own sentences.
SENTENCES = tuple(
    x.strip()
    for x in """
N said that the meeting moved to Monday.|F said the O was fine; F disagreed.|Then N rebooted the host.|N called yesterday about the W.|We met N at the station.|I spoke with N about the O.|Please ask for N before noon.
Yesterday N and N found that the W was gone.|It was agreed between N and N that the W stays.|G and G think that the W works.|As expected, N found that it holds.|The parcel for N, O Street 5, was lost.|Mark it for N.
The badge for N was issued in May.|Account of N, id 4411.|"No," wrote N in the log.|N asked why.|Dr. N asked why nobody came.|N's laptop is broken.|G's desk is free.|The report by N is late.|Invoice went to N, 12 O Road.
Waiting for N.|Heard from G about the W.|N wrote on the 3rd.|Thanks G, I will look.|thx G, will do.|Dear G,|Hi G!|-- G|On call from 08:00: G, then G, then N.|visitor N, host N.|Signed: N, 12 O Lane|N will sign off at six.
N took over at 10:00.|N handed the pager on.|N drove there in person.|Contact N for details.|Our colleague N lives in O.|My name is N and I work at O.|N lives in O.|N joined O in June.|The manager, N, left.|According to N, the O is slow.
name;phone\\nN;+1 415 555 0100|1) N / +44 20 7946 0000|Cc: N <a@b.example>|{"who":"N","x":1}|name: N\\nphone: 1|Regards,\\nN|Cheers,\\nG\\n|-- \\nN\\n12 O Road|seen by N yesterday|so N went there.|Patient N was born in 1980.|N is the owner.
Herr F meint, der W ist gut.|Frau N hat an O geschrieben.|Laut G: der W steht.|N meint: der W steht.|Bitte nach N fragen.|Die Platte geht zu Händen N.|Übergabe an Frau F, erreichbar.|Steuernummer 123 von N.|N hat gestern angerufen.|Seit gestern gilt: N meint: es geht.
Mit freundlichen Grüßen\\nN|Der Kollege N wohnt in O.|M. F a pris la relève.|Selon G, le W est lent.|D'après G, le W est lent.|N affirme que le W est lent.|présentée à l'accueil par N.|merci G, je regarde.|à l'attention de N.|Le numéro 12 de N.|Veuillez demander N avant midi.
Cordialement,\\nN|La Sra. N tomó el turno.|Según G, el W es lento.|N cree que el W falla.|mostrado en recepción por N.|Pregunte por N antes de las dos.|a la atención de N.|El DNI 12 de N.|Saludos,\\nN|gracias G, lo miro.|En O, N cree que no.|Mi vecina N vive en O.
The O replica said the same.|O and O agree.|The O is slow.|O is down since Monday.|Open O and O.|At O the W stopped.|May brought less traffic.|Grace of a slow hour.|Will the W stop?|March was quiet.|The Grant Harbor replica is back.|Mark the rows.|Rule O is on.
By O we mean the O.|Monday and Tuesday were fine.|In June the O W moved.|O W is W.|Restart O before noon.|Read the O report.|Ask the O team.|From O to O in two hours.|The O Harbour view changed.|See O for details.|## O O\\n|O: W W.|Der O steht seit Montag.|Die O Regel gilt.|Das O W ist neu.
Le O est lent.|La O de O est lente.|El O no responde.|La O es nueva.|Nach dem Neustart begann der Zähler.|Die Gebühren lagen bei drei.|Ein Treffer ist kein Beweis.|Les frais tournaient autour de deux.|Un signal n'est pas une preuve.|Una señal no es una prueba.|La captura original no explica nada.
Counters read 9.|Small files again.|Last week was slow.|Two observers reported it.|Never trust the O.|Sent from O.|Mark every row.|Mark all of them.|Will we stop?|Grant access to O.|Grace period is over.|Rose by a third.|Bill the customer.|Frank words helped.|May we stop?|Iris scans are off.|Will it hold?|Mark it as done.|mark it as late.|Let's see.|Let it run.|Median size was small.|Write to us.|Viele Grüße|Zwei Beobachter meldeten es.|To be checked: the W.|Zu prüfen: der W.|Forwarded to O.|Escalated to O.|Complaint from O.|F thinks that the W is slow.|F reported that the W is slow.|the WINDOW was SMALL AND LATE.|CAPTURE W AGAIN.|Session O was re-read.|Window O held rows.|Window W is open.|Deliver to: 5 O Street, O.|Call 123 on arrival.|Passport 123 was shown.|Somebody pasted it.|Version O is out.|41 Park W, 12 Hill W.|9 Green W, 3 White W and 7 King W.|12 Main W, 5 Lane W; lane 3 of the W.|O, O and O agree.|O, O and O agree on 4 W.|O and O were slow, O was not.|We use O, O and O.|O runs O on O.|The new O is here.|Our O team left.|A O W is W.|Use O for it.|Install O first.|An O error came up.|This O W is late.|The White House said no.|The Young Report is out.|Green light for O.|King size W.|North O and South O.|New York and Los Angeles are far.|San Francisco was warm.|Lake Constance is calm.|Mount Everest is high.|She moved to New Zealand.|Der Bericht von Montag liegt vor.|Im Januar war die Zählung falsch.|Die neue Anlage der Stadt O ist da.|Das Ministerium in O hat entschieden.|La ville de O est belle.|Le ministère de O a dit non.|La ciudad de O es grande.|El Ministerio de O dice que no.|United Nations met in O.|The European Union agreed.|Terms of O apply.|Chapter Two begins.|Read Chapter 3 of the O Guide.|HTTP and JSON are used.|API keys of O.|The CPU of O is hot.|PDF of the O.|SELECT W FROM O WHERE W = 1 GROUP BY W;
INFO O started.|WARN W is late.|ERROR O failed: W.|The Isolation Forest and the Quality Gate are new.|If the W stays, pause the O.|Don't touch the O.|Nobody knows why the W left.|Home office until noon.|Ship the disk to 5 O Avenue.|Good Morning Team|Best Practice Guide|Terms of Service apply.
""".replace("\n", "|").split("|")
    if x.strip()
)
#: What persons do, and nouns that German writes in capitals. Fixed values.
VERBS = tuple(
    "plays sings paints cooks writes reads sleeps travels teaches studies works runs swims drives flies walks waits smiles laughs wins loses buys sells builds repairs opens closes likes loves hates knows sees hears wants needs has brings takes gives sends moved left arrived stayed bought sold forgot remembered opened closed finished started painted wrote won lost saw heard met helped asked answered called promised refused decided visited".split()
)
VERBS_ELSEWHERE = (
    "arbeitet wohnt spielt singt kocht schreibt liest fährt kommt geht bleibt kauft verkauft baut öffnet sieht hört weiß sagt fragt",
    "travaille habite joue chante écrit lit vient part reste achète vend ouvre voit sait dit demande arrive cherche",
    "trabaja vive juega canta escribe lee viene sale queda compra vende abre ve sabe dice pregunta llega busca",
)
NOUNS = tuple(
    "Zug Stock Vertrag Vortrag Schlüssel Verspätung Garten Brief Abend Woche Straße Küche Auto Kind Frau Mann Arbeit Zeit Jahr Monat Stunde Seite Buch Tür Fenster Tisch Schrank Lampe Wasser Brot Kaffee Rechnung Anlage Antwort Frage Sitzung Leitung Maschine Messung Störung Meldung Nachricht Ordnung Lieferung Verwaltung Abteilung Genehmigung Umgebung Wirkung Ladung Schicht Datei Liste Tabelle Spalte Zeile Wert Grund Fehler Plan Bau Platz Ort Land Stadt Dorf Weg".split()
)


def _verbs(draw: random.Random) -> Iterator[str]:
    """Further sentences: of doing, in four languages, and of German nouns."""
    german, french, spanish = (v.split() for v in VERBS_ELSEWHERE)
    for v in VERBS:
        yield f"N {v} " + draw.choice(("the W every O.", "a W.", "at home.", "the W again.", "very well.", "on Sunday.", "with N.", "the children."))
        yield f"The {draw.choice(PLAIN)} that N {v} was new." if draw.random() < 0.5 else f"When N {v}, all was quiet."
    for v in german:
        d = draw.choice(("den", "die", "das", "im", "am", "einen"))
        yield f"N {v} {d} {draw.choice(NOUNS)}."
        yield f"{draw.choice(('Heute', 'Gestern', 'Dann', 'Am Abend'))} {v} N {d} {draw.choice(NOUNS)}."
        yield f"{draw.choice(('Der', 'Die', 'Das', 'Ein'))} {draw.choice(NOUNS)} von N {v} {d} {draw.choice(NOUNS)}."
        yield f"{draw.choice(('Der', 'Die', 'Das'))} {draw.choice(NOUNS)} {v} {d} {draw.choice(NOUNS)} und {draw.choice(NOUNS)}."
        yield f"{draw.choice(NOUNS)} und {draw.choice(NOUNS)} sind da, {draw.choice(NOUNS)} fehlt."
    for v in french:
        yield f"{draw.choice(('Hier ', 'Demain ', '', 'Ici '))}N {v} {draw.choice(('le W', 'la W', 'ici', 'demain'))}."
        yield f"Le W de N {v} bien."
    for v in spanish:
        yield f"{draw.choice(('Ayer ', 'Hoy ', '', 'Aquí '))}N {v} {draw.choice(('el W', 'la W', 'aquí', 'mañana'))}."
        yield f"El W de N {v} bien."
    for w in sorted(THINGS):
        yield f"The {draw.choice(OTHER)} {w.capitalize()} is W." if draw.random() < 0.5 else f"We saw the {draw.choice(OTHER)} {draw.choice(OTHER)} {w.capitalize()}."


OTHER = tuple(
    "Kafka Grafana Athena Berlin London Paris Madrid Tokyo Google Linux Python Spark Oracle Apollo Harbour Gateway Collector Dashboard Harvest Monitor Station Bridge Release Signal Ledger Window Queue Broker Replica Archive Customer Service Network Market Central Library University Hospital Ministry Council Summit Project Alpha Omega Phoenix Mercury"
    " Gebühren Zähler Bericht Sammler Stundenordner Rückstau Zahlung Treffer Regel Kapture Tableau Rapport Passerelle Capteur Panneau Informe Captura Regla Tablero Colector".split()
)
PLAIN = tuple("counter report meeting queue worker threshold panel chart sample batch cable server invoice ticket rule window writer bericht zähler rapport compteur informe tablero".split())
_HEADS = "Ad Al Ar Be Bo Bra Cha Da De Dra Du E Fa Fri Ga Gri Ha Hol I Jo Ka Ke Ko La Li Lu Ma Mi Mo Na Ne Nu O Or Pe Pro Ra Ri Ro Sa Se Si So Sta Ta Te Ti To U Va Ve Vi Wa We Wi Ya Yo Za Ze Zu".split()
_MIDDLES = "b d l m n r s t v k z ll nn rr ss st nd lm rk rn nt rd ns dr mb".split()
_TAILS = "a e i o an en in on ar er or as is us ic ov ek el al ia io ien ander ert olf win mar dal berg mann ski son sen ez es ini elli uk enko ara ura eau ard ette ine".split()


def _made(draw: random.Random) -> str:
    """A word that looks like a name and stands in no list."""
    w = draw.choice(_HEADS) + draw.choice(_MIDDLES) + draw.choice(("", "a", "e", "i", "o", "u", "a" + draw.choice(_MIDDLES))) + draw.choice(_TAILS)
    return w[0] + w[1:].replace("'", "")


def _name(kind: str, draw: random.Random) -> list[tuple[str, bool]]:
    """(word, in the name) of a drawn name."""
    common = draw.random() < 0.35
    given = draw.choice(_GIVEN_LIST).capitalize() if common else _made(draw)
    family = draw.choice(_FAMILY_LIST).title() if common else _made(draw)
    if not common and draw.random() < 0.25:
        family += "-" + _made(draw)
    if draw.random() < 0.12:
        family = draw.choice(("O'", "d'", "Mac", "Mc")) + family
    part = draw.choice(("von ", "van ", "de la ", "de ")) if draw.random() < 0.12 else ""
    if kind == "G":
        text = given
    elif kind == "F":
        text = part + family
    else:
        r = draw.random()
        initial = f" {draw.choice('ABCDEFGHJKLMNPRSTW')}." if r < 0.1 else ""
        text = f"{family}, {given}" if 0.1 <= r < 0.2 else f"{given[0]}. {part}{family}" if 0.2 <= r < 0.26 else part + family if 0.26 <= r < 0.32 else given if 0.32 <= r < 0.38 else f"{given}{initial} {part}{family}"
    if draw.random() < 0.06:
        text = text.upper()
    return text


_GIVEN_LIST, _FAMILY_LIST = sorted(GIVEN), sorted(FAMILY)


def sentences(copies: int = 8, seed: int = 11) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """(text, spans of names): each sentence filled so many times."""
    import re

    draw = random.Random(seed)
    for _ in range(copies):
        for s in (*SENTENCES, *_verbs(draw)):
            out, spans = "", []
            lead = draw.choice(("", "", "The run ended. ", "[10:20] @ops: ", "Es geht. ", "C'est fini. ", "Ya está. "))
            out += lead
            for piece in re.split(r"(?<![\w'\"])([NGFOW])(?![\w])|(?<=\")(N)(?=\")", s.replace("\\n", "\n")):
                if piece is None:
                    continue
                if piece in ("N", "G", "F"):
                    n = _name(piece, draw)
                    spans.append((len(out), len(out) + len(n)))
                    out += n
                elif piece == "O":
                    out += draw.choice(OTHER)
                elif piece == "W":
                    out += draw.choice(PLAIN)
                else:
                    out += piece
            yield out, spans


# ---------------------------------------------------------------- fitting


@dataclass
class Model:
    """Weights of features, name parts the corpus taught (with how often each stood first and last), common words, and towns."""

    weights: dict[str, float] = field(default_factory=dict)
    parts: dict[str, tuple[int, int]] = field(default_factory=dict)
    common: frozenset[str] = frozenset()
    towns: tuple[str, ...] = ()

    def is_given(self, w: str) -> bool | None:
        """True or False where it is known, else None."""
        if w in self.parts:
            first, last = self.parts[w]
            if first + last:
                return first > last
        g, f = w in GIVEN, w in FAMILY
        return g if g != f else None


def gradient(w, flat, size, y, v):
    """What a block of examples adds to the gradient of the logistic loss at the weights w.

    Of each example: its number of features (their ids follow one another in flat), its label and its weight.
    """
    import numpy as np

    owner = np.repeat(np.arange(len(size)), size)
    z = np.bincount(owner, weights=w[flat], minlength=len(size))
    g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * v
    return np.bincount(flat, weights=g[owner], minlength=len(w))


def descend(gradient_at, n: int, total: float, rounds: int = 80, decay: float = 1e-4):
    """n weights of a logistic regression over sets of features, by full gradients with Adam. total: the weight of all examples."""
    import numpy as np

    w, m, s = np.zeros(n), np.zeros(n), np.zeros(n)
    for k in range(1, rounds + 1):
        grad = gradient_at(w) / total + decay * w / n**0.5
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad * grad
        w -= 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.999**k)) + 1e-9) * min(1.0, 20 / k)
    return w


def patterns() -> tuple:
    """The compiled patterns of tokens and of places."""
    import regex

    return regex.compile(TOKEN), [regex.compile(p, regex.M) for p in PLACES]


def stands(t: Text, places) -> tuple[list[int], list[tuple[int, int]]]:
    """Tokens that stand where a name must, once for each such place, and the two of names of two words."""
    placed, pairs = [], []
    for run in in_places(t, places):
        words = [i for i in run if candidate(t, i, {}) and t.low[i] not in PARTICLES or t.word[i].islower() and len(t.word[i]) > 2 and t.low[i] not in PARTICLES]
        if not 1 <= len(words) <= 4 or any(t.low[i] in FUNCTION or t.low[i] in TITLES for i in words):
            continue
        placed += words
        if len(words) == 2 and not any(t.word[j] == "," for j in range(words[0], words[1])):
            pairs.append((words[0], words[1]))
    return placed, pairs


def tally(t: Text, places, counts: dict[str, list[int]]) -> None:
    """Counts a text in: of each word how often it is placed, elsewhere in capitals, elsewhere small, first and last of two."""
    placed, pairs = stands(t, places)
    for i in placed:
        counts[t.low[i]][0] += 1
    for first, last in pairs:
        counts[t.low[first]][3] += 1
        counts[t.low[last]][4] += 1
    inside = set(placed)
    for i, w in enumerate(t.word):
        if w[0].isalpha() and i not in inside and t.free(i):
            counts[t.low[i]][2 if w.islower() else 1] += 1


@dataclass(frozen=True)
class Lexicon:
    """What the words of a corpus are: parts of names, common, and those that stand as counterexamples."""

    parts: dict[str, tuple[int, int]] = field(default_factory=dict)
    common: frozenset[str] = frozenset()
    plain: frozenset[str] = frozenset()


def lexicon(counts: Iterable[tuple[str, int, int, int, int, int]], n: int) -> Lexicon:
    """From the words of n texts with what `tally` counted. No word is of use that is neither placed twice, nor twice
    small, nor RARE times in capitals."""
    x = max(1.0, n / STATED)
    parts, common, plain = {}, set(), set()
    for w, placed, capital, small, first, last in counts:
        if placed >= 2 and placed >= 0.1 * capital and small <= 0.5 * placed and w not in CALENDAR and w not in FUNCTION:
            parts[w] = (first, last)
            continue
        stray = placed < x and placed <= STRAY * (capital + small)
        if small >= COMMON * x or stray and capital >= COMMON_CAPITAL * x:
            common.add(w)
        if stray and capital and (small >= max(2, 0.25 * capital) or capital >= RARE * x):
            plain.add(w)
    return Lexicon(parts, frozenset(common), frozenset(plain))


def examples(t: Text, places, lex: Lexicon) -> Iterator[tuple[list[str], int, int]]:
    """(features, label, weight in tenths) of a text's words. Each word is shown both with what the corpus taught about it
    and without, so that words it taught nothing about are known by the rest."""
    inside = set(stands(t, places)[0])
    for i, low in enumerate(t.low):
        if low in PARTICLES or not candidate(t, i, lex.parts) or not t.free(i):
            continue
        if i in inside or low in lex.parts:
            label, weight = 1, NAME
        elif low in lex.plain:
            label, weight = 0, NO_NAME
        else:
            continue
        taught, bare = features(t, i, lex.parts, lex.common), features(t, i, {})
        if taught == bare:
            yield taught, label, weight
        else:
            yield taught, label, round(TAUGHT * weight)
            yield bare, label, weight - round(TAUGHT * weight)


def own_examples() -> Counter[tuple[tuple[str, ...], int]]:
    """The weight of each (features, label) of the labelled sentences."""
    token, _ = patterns()
    out: Counter[tuple[tuple[str, ...], int]] = Counter()
    for x, spans in sentences():
        t = Text(x, token)
        for i in range(len(t.word)):
            if candidate(t, i, {}) and t.low[i] not in PARTICLES:
                out[tuple(features(t, i, {})), int(any(a <= t.start[i] < b for a, b in spans))] += NAME
    return out


def seen(weighed: Iterable[tuple[Iterable[str], int]]) -> set[str]:
    """Features that count. weighed: features and their weight."""
    out: Counter[str] = Counter()
    for features_, weight in weighed:
        for x in features_:
            out[x] += weight
    return {x for x, n in out.items() if n >= SEEN}


def block(rows: Iterable[tuple[Iterable[str], int, float]], index: dict[str, int]) -> tuple:
    """flat, size, y, v of `gradient`, from (features, label, weight)."""
    import numpy as np

    flat, size, y, v = [], [], [], []
    for features_, label, weight in rows:
        ids = [index[x] for x in features_ if x in index]
        flat += ids
        size.append(len(ids))
        y.append(label)
        v.append(weight)
    return np.array(flat, np.int32), np.array(size, np.int32), np.array(y, np.int8), np.array(v, np.float64)


def model_of(index: dict[str, int], w, lex: Lexicon) -> Model:
    return Model({f: round(float(w[k]), 3) for f, k in index.items() if abs(w[k]) >= 0.02}, lex.parts, lex.common)


def fit() -> Model:
    """A model of the labelled sentences alone; `fitting.fit` is that of a corpus."""
    own = own_examples()
    index = {f: k for k, f in enumerate(sorted(seen((f, n) for (f, _), n in own.items())))}
    rows = block(((f, y, n) for (f, y), n in own.items()), index)
    return model_of(index, descend(lambda w: gradient(w, *rows), len(index), rows[3].sum()), Lexicon())


def in_places(t: Text, places) -> list[list[int]]:
    """Runs of tokens that stand where a name must."""
    import bisect

    out = []
    for p in places:
        for m in p.finditer(t.text):
            a, b = m.span("n")
            lo, hi = bisect.bisect_left(t.start, a), bisect.bisect_left(t.start, b)
            run = list(range(lo, hi))
            if run:
                out.append(run)
    return out


# ---------------------------------------------------------------- finding


class NameFinder:
    """A model at work. `spans` gives (start, end) of names in a text, ordered, without overlaps."""

    def __init__(self, model: Model):
        import regex

        self.model = model
        self.token = regex.compile(TOKEN)
        self.places = [regex.compile(p, regex.M) for p in PLACES]
        self.han = regex.compile(rf"(?<!\p{{Han}})(?:(?:{HAN_FAMILY})\p{{Han}}{{1,3}}?(?=(?:{HAN_ADDRESS})|\P{{Han}}|$)|(?:{HAN_FAMILY})(?={HAN_ADDRESS})|[{HAN_SHORT}]\p{{Han}}{{0,2}}?(?=先生|女士|小姐))")

    def _marked(self, t: Text) -> list[bool]:
        model, weights, parts = self.model, self.model.weights, self.model.parts
        placed = {i for run in in_places(t, self.places) for i in run}
        score: dict[int, float] = {}
        for i, w in enumerate(t.word):
            low = t.low[i]
            if not w[0].isalpha() or low in PARTICLES or low in TITLES or t.initial(i):
                continue
            in_place = i in placed and len(w) > 1
            if low not in FUNCTION and low not in THINGS and (in_place or candidate(t, i, parts) and t.free(i)):
                score[i] = sum(weights.get(f, 0.0) for f in features(t, i, parts, self.model.common)) + (PLACE_BONUS if in_place else 0.0)
        sure = {i for i, x in score.items() if x > CUT}
        todo = list(sure)
        while todo:  # a name pulls its neighbours in
            i = todo.pop()
            for j in self._beside(t, i):
                if j not in sure and t.low[j] not in FUNCTION and self._pulled(t, i, j, score):
                    sure.add(j)
                    todo.append(j)
        for i in sorted(sure):  # 'Family, Given' before something small
            if i + 3 < len(t.word) and t.word[i + 1] == "," and i + 2 in score and i + 2 not in sure and t.low[i + 2] not in self.model.common and self.model.is_given(t.low[i]) is not True:
                lone = i - 1 not in sure and not t.initial(i - 2)
                if lone and self.model.is_given(t.low[i + 2]) is not False and score[i + 2] + COMMA_BONUS > CUT and (t.word[i + 3].islower() or not t.is_word(i + 3)) and t.word[i + 3] != ",":
                    sure.add(i + 2)
        things = [i for i in range(len(t.word)) if t.low[i] in THINGS and not t.word[i].islower()]
        while things:  # what stands beside a thing in capitals names the thing
            i = things.pop()
            for j in self._beside(t, i):
                if j in sure and j not in placed and score[j] < CERTAIN:
                    sure.discard(j)
                    things.append(j)
        return [i in sure for i in range(len(t.word))]

    def _pulled(self, t: Text, i: int, j: int, score: dict[int, float]) -> bool:
        """Whether word j belongs to the name that word i is part of."""
        common = t.low[j] in self.model.common
        if t.low[j] in CALENDAR and (j > i or t.low[j].endswith(("day", "tag"))):
            return False
        if j not in score:  # written small: only behind a name written small
            return j > i and not common and t.word[i].islower() and len(t.word[j]) > 3 and t.low[j] not in TITLES
        return score[j] + (BESIDE_COMMON if common else BESIDE_BONUS) > CUT

    def _beside(self, t: Text, i: int) -> list[int]:
        """The words before and behind i, with only blanks, initials and particles between."""
        out = []
        for step in (1, -1):
            j = i
            for _ in range(6):
                j += step
                if not 0 <= j < len(t.word) or t.text[t.end[j - 1] : t.start[j]].strip(" \t") if step > 0 else not 0 <= j < len(t.word) - 1 or t.text[t.end[j] : t.start[j + 1]].strip(" \t"):
                    break
                if t.initial(j) or t.word[j] == "." and t.initial(j - 1) or t.low[j] in PARTICLES:
                    continue
                if abs(i - j) > 1 and t.low[min(i, j) + 1] in PARTICLES and t.low[min(i, j) + 1] not in LEADING:
                    break
                if t.word[j][0].isalpha() and t.start[max(i, j)] > t.end[min(i, j)]:
                    out.append(j)
                break
        return out

    def _glued(self, t: Text, i: int, j: int) -> bool:
        """Nothing but blanks between two tokens."""
        gap = t.text[t.end[i] : t.start[j]]
        return gap != "" and not gap.strip(" \t") if not t.initial(i) else not gap.strip(" \t.")

    def spans(self, text: str) -> list[tuple[int, int]]:
        t = Text(text, self.token)
        marked = self._marked(t)
        runs: list[list[int]] = []
        i, n = 0, len(t.word)
        while i < n:
            if not marked[i]:
                i += 1
                continue
            run, j = [i], i
            while True:
                k = j + 1
                if t.word[j : j + 1] and t.initial(j):
                    k = j + 2
                if k < n and self._glued(t, j, k):
                    if marked[k] or t.initial(k):
                        run.append(k)
                        j = k
                        continue
                    q = k
                    while q < n and t.low[q] in PARTICLES and self._glued(t, q - 1, q):
                        q += 1
                    if q > k and q < n and t.low[k] in LEADING and marked[q] and self._glued(t, q - 1, q):
                        run += [*range(k, q + 1)]
                        j = q
                        continue
                break
            runs.append(run)
            i = j + 1
        out: list[tuple[int, int]] = []
        for run in runs:
            first, last = run[0], run[-1]
            words = [k for k in run if marked[k]]
            while first >= 2 and t.word[first - 1] == "." and t.initial(first - 2) and not t.text[t.end[first - 1] : t.start[first]].strip(" \t") and not self._title(t, first - 2, words):
                first -= 2
            if first == run[0]:
                q = first - 1
                lead = self._before_particles(t, first)
                if lead < first:
                    first = q = lead
                    out.append((first, last))
                    continue
                while q >= 0 and t.low[q] in PARTICLES and self._glued(t, q, q + 1):
                    q -= 1
                q += 1
                if q < first and len(words) == 1 and self._noble(t, q, first):
                    first = q
            out.append((first, last))
        return sorted([*self._families_first(t, out), *((m.start(), m.end()) for m in self.han.finditer(text))])

    def _before_particles(self, t: Text, first: int) -> int:
        """Where 'E. von' before a word begins; first itself where nothing of the kind stands there."""
        q = first
        while q > 0 and t.low[q - 1] in PARTICLES and self._glued(t, q - 1, q):
            q -= 1
        begin = first
        while q < first and q >= 2 and t.word[q - 1] == "." and t.initial(q - 2):
            q = begin = q - 2
            first = q + 1
        return begin

    def _title(self, t: Text, i: int, words: list[int]) -> bool:
        """'M.' of a French text is a form of address."""
        return t.word[i] == "M" and any(t.low[j] in ("a", "et", "le", "la", "est", "au", "que", "pour") for j in range(words[-1] + 1, min(len(t.word), words[-1] + 5)))

    def _noble(self, t: Text, q: int, first: int) -> bool:
        """Whether particles before a lone word belong to it: 'von Berg said', not 'de Anna' or 'von Anna'."""
        if self.model.is_given(t.low[first]):
            return False
        return t.word[q][0].isupper() or q + 1 < first or t.low[q] in ("van", "der", "bin", "ibn", "al") or t.low[q] == "von" and (q == 0 or not t.is_word(q - 1) or not t.word[q - 1][-1:].isdigit()) or t.low[q] == "de" and (q == 0 or not t.is_word(q - 1))

    def _families_first(self, t: Text, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Spans of text; 'Family, Given' is one name."""
        out, k = [], 0
        while k < len(runs):
            a, b = runs[k]
            if k + 1 < len(runs):
                c, d = runs[k + 1]
                one = sum(t.low[x] not in PARTICLES for x in range(a, b + 1)) == 1 and sum(t.is_word(x) and not t.initial(x) for x in range(c, d + 1)) == 1
                if one and c == b + 2 and t.word[b + 1] == "," and t.text[t.end[b + 1] : t.start[c]].strip(" \t") == "" and self.model.is_given(t.low[b]) is not True and self.model.is_given(t.low[c]) is not False:
                    out.append((t.start[a], self._close(t, d)))
                    k += 2
                    continue
            out.append((t.start[a], self._close(t, b)))
            k += 1
        return out

    def _close(self, t: Text, i: int) -> int:
        """The end of a name: with the full stop of an initial."""
        return t.end[i + 1] if t.initial(i) else t.end[i]


_BASE: list[Model] = []


def base_model() -> Model:
    """The model of the sentences alone, fitted once in a process."""
    if not _BASE:
        _BASE.append(fit())
    return _BASE[0]
