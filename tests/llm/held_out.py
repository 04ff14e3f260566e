"""Sentences written for the tests of personal information, none of them among those that the operator is fitted on.

They were seen while the operator was made: rules and word lists were changed with their misses in view, so they guard
against steps back and measure nothing new. Marked as <kind|value>.
"""

SENTENCES = """
Yesterday <name|Maria Lopez> forgot her umbrella in the library.
The winning photograph was taken by <name|Jonathan Smith>.
<name|Dr|>Our dentist, Dr. <name|Emily Chen>, retires in spring.
A thank-you card from <name|Fatima Al-Sayed> hung on the fridge.
<name|Anna Schmidt> wohnt seit Jahren in Leipzig.
My neighbour <name|Li Wei> repairs bicycles.
<name|田中太郎>さんは来週東京に行きます。
<name|Anna Berg> rebooted the host after lunch.
The novel that <name|Thomas Moreau> dedicated to his sister sold well.
Nobody told <name|Priya Raman> that the shop was shut.
<name|Oluwaseun Adeyemi> plays the trumpet every Sunday.
Our plumber is called <name|Radoslav Kettering>.
When <name|Ingrid Halvorsen> sang, the room went quiet.
The trophy went to <name|Mateus Ferreira> and <name|Lucy Grant>.
She borrowed the ladder from <name|Tom Okonkwo>.
Prof. <name|Hiroshi Tanabe> lectures on tides.
Mr. <name|Delacroix> prefers tea.
Mrs. <name|Van Houten> bakes bread on Fridays.
The letter was addressed to <name|Zofia Wieczorek>.
<name|Paul O'Donnell>'s boat leaks.
It was <name|Greta Lindqvist> who found the key.
Lieber <name|Jonas>, bitte bring den Schlüssel mit.
Gestern hat <name|Katrin Vogelsang> den Zug verpasst.
Der Vortrag von <name|Matthias Brenner> begann zu spät.
Herr <name|Ziegler> hat den Vertrag unterschrieben.
Frau <name|Yildiz> arbeitet im zweiten Stock.
Hier <name|Camille Rousseau> a perdu ses gants.
Le tableau est signé <name|Antoine Lemaire>.
Mme <name|Bouchard> arrive demain matin.
Bonjour <name|Hélène>, merci pour le livre.
Ayer <name|Lucía Herrera> compró un piano.
El premio fue para <name|Javier Montalbán>.
La Sra. <name|Quiroga> vive en la plaza.
Hola <name|Diego>, nos vemos el lunes.
<name|Kwame Boateng> told the children a story.
The interview with <name|Sofia Marchetti> lasted an hour.
A package for <name|Beatrix Thornbury> is at the desk.
I still owe <name|Samir Haddad> twenty euros.
<name|Nadia Petrova> won the race ahead of <name|Eva Novak>.
Best regards,
<name|Wilhelmina Draycott>
The Pacific Ocean is deep, and Mount Fuji is high.
Amazon and Microsoft announced new offices in Dublin.
In August the Supreme Court ruled on the Clean Air Act.
Visit the British Museum before Thursday.
Die Deutsche Bahn meldet Verspätungen in Hannover.
La Tour Eiffel ferme en novembre.
El Museo del Prado abre los domingos.
Write to <email|harold.p@woodland.example> for a leaflet.
My address is <email|kim_lee+news@mail.co.example>, thanks.
Reach us under <email|info at gardenclub dot example>.
Contacto: <email|lucia (arroba) museo (punto) example>.
Forward it to <email|ZOE.K@ARTS.EXAMPLE>.
Send bills to <email|accounts [at] bakery [dot] example> only.
Mail: <email|j-w.meier@verein.example>; no calls please.
Subscribe via <email|hello@radio.example> today.
Neu: <email|post(ät)laden(punkt)example>.
Ask <email|office.dept@city.example> about permits.
My phone number is <phone|5551234567>.
Ring me at <phone|(212) 555-0187> after six.
Office: <phone|+44 20 7946 0123 ext. 12>.
Tel. <phone|030 1234 5678>, abends.
電話: <phone|090-1234-5678>
Appelez le <phone|01 23 45 67 89> avant midi.
Llame al <phone|+34 912 345 678> por la tarde.
Her new mobile: <phone|+1-646-555-0133>.
Rufen Sie <phone|+49 (0)89 123456> an.
Fax <phone|0044 161 496 0321> still works.
Her social security number is <id_number|123-45-6789>.
Passport <id_number|AB1234567> expires in June.
Mi DNI es <id_number|12345678Z>.
National insurance number <id_number|AB 12 34 56 C>.
Steuer-ID: <id_number|86095742719>
Numéro de sécurité sociale <id_number|1 84 12 76 451 089 46>.
Id card <id_number|L01X00T47> was lost.
NIE <id_number|X1234567L> caducado.
SSN: <id_number|987 65 4321> was on the form.
Tax id <id_number|12 345 678 901> belongs to the club.
They live at <address|12 Maple Street, Springfield 62704>.
Ship to <address|221B Baker Street, London NW1 6XE>.
Besuch uns: <address|Lindenstraße 14, 10969 Berlin>.
Write to <address|P.O. Box 123, Portland 97201>.
Adresse : <address|15 rue de la République, 69002 Lyon>.
Domicilio: <address|Calle Mayor 5, 28013 Madrid>.
The shop moved to <address|480 Ocean Avenue, Apt 5>.
Paket an <address|Am Markt 3, 99084 Erfurt>.
Venez au <address|8 avenue Victor Hugo, 75116 Paris>.
Office: <address|900 Lakeshore Drive, Suite 300, Chicago 60611>.
""".strip().replace("<name|Dr|>", "")


def cases() -> list[tuple[str, list[tuple[str, int, int]]]]:
    """(text, (kind, start, end) of what it holds), two lines together where one ends in a comma."""
    import re

    out = []
    for line in re.split(r"(?<!,)\n", SENTENCES):
        text, spans, at = "", [], 0
        for m in re.finditer(r"<(\w+)\|([^>]*)>", line):
            text += line[at : m.start()]
            spans.append((m[1], len(text), len(text) + len(m[2])))
            text += m[2]
            at = m.end()
        out.append((text + line[at:], spans))
    return out
