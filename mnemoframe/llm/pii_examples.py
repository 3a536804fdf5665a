"""Composed sentences with marked items, to train the random field and to test it on others.

Everything is written from general knowledge of how letters, forms and chats
look and of public number formats; no sentence, name or number comes from a
table.  Sentences, given names and family names fall into two halves: what
``compose(..., held_out=True)`` uses is never seen in training.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

#: Given names common in several countries; the field knows only every second one as a given name.
GIVEN_NAMES = """
james mary john patricia robert jennifer michael elizabeth william barbara richard susan charles jessica christopher margaret matthew catherine
anthony donald steven andrew joshua kenneth timothy ronald edward nicholas jonathan benjamin gregory alexander raymond dennis jerry ashley emily kimberly betty michelle amanda melissa deborah stephanie rebecca cynthia kathleen angela dorothy shirley brenda nicole pamela samantha katherine christine debra carolyn janet heather diane
david linda joseph karen thomas nancy daniel lisa paul sandra mark donna george carol kevin ruth brian sharon jason amy jeffrey anna ryan emma jacob olivia
gary sophie eric grace stephen chloe larry hannah justin lucy scott megan frank alice julia diana samuel laura patrick sarah jack rachel
peter claudia stefan petra andreas monika jürgen sabine wolfgang heike uwe birgit klaus anja lukas lena felix marie pierre camille jean élodie luc nathalie antoine sylvie
carlos lucía javier carmen diego elena miguel rosa pablo inés marco giulia luca chiara paolo francesca matteo valentina jan katarzyna piotr agnieszka tomasz zofia
ivan olga sergei natalia dmitri tatiana ahmed fatima omar aisha hassan leila ali yasmin raj priya arjun ananya vikram meera wei mei hiroshi yuki kenji sakura
minh lan joão beatriz lars ingeborg erik astrid sven freja kwame amara
""".split()
FAMILY_NAMES = """
smith johnson brown taylor miller wilson moore anderson jackson white harris martin clark lewis walker hall young king wright hill green baker adams nelson carter mitchell
müller schmidt schneider fischer weber wagner becker hoffmann schulz koch bauer richter klein wolf neumann dubois durand moreau laurent lefebvre roux fournier girard
garcía martínez lópez sánchez pérez gómez fernández ruiz rossi russo ferrari bianchi romano gallo conti nowak kowalski wiśniewski ivanov petrov sokolov khan hussain rahman
singh patel sharma gupta chen wang zhang tanaka suzuki sato nguyen tran silva santos costa hansen larsen nilsson berg lindqvist okafor mensah o'brien mcdonald
""".split()

WITH_ITEMS = """
Dear {NAME}, thank you for your letter of last week.
Hello {NAME}, are you free tomorrow?
Hi {NAME} - quick question about the budget.
Best wishes, {NAME}
Kind regards
{NAME}
Yours sincerely, {NAME}
cheers, {NAME}
I spoke to {NAME} this morning and everything is agreed.
{NAME} will join the meeting later.
{NAME} and {NAME} are getting married in June.
Yesterday {NAME} told me the whole story.
Have you seen {NAME} recently?
Who is {NAME}?
Please forward this to {NAME} as soon as possible.
The doctor, {NAME}, wants to see the results.
Mr {NAME} has left the building.
Mrs. {NAME} called twice.
Dr. {NAME} is on holiday until Monday.
Herr {NAME} ist heute nicht im Büro.
Frau {NAME} hat angerufen.
Madame {NAME} vous attend.
El señor {NAME} no está.
According to {NAME}, the price is too high.
It was {NAME} who found the error.
{NAME}'s birthday is on Friday.
We had dinner with {NAME} at the harbour.
My brother {NAME} plays the cello.
my friend {NAME} said so
her teacher, {NAME}, retired
Patient: {NAME}, born in spring.
Applicant {NAME} submitted form nine.
Attendees: {NAME}, {NAME} and {NAME}.
Signed by {NAME} on behalf of the tenants.
{NAME}: ok, see you then
The tenant {NAME} owes two months of rent.
Ich habe gestern {NAME} getroffen.
J'ai parlé avec {NAME} ce matin.
Ayer hablé con {NAME} sobre el viaje.
Ho visto {NAME} alla stazione.
give my love to {NAME} please
Did {NAME} ever answer you?
{NAME} paid in cash.
I owe {NAME} ten euros.
A card for {NAME} came in the mail.
My phone number is {PHONE}.
Phone: {PHONE}
Mobile {PHONE}, office {PHONE}
You can call me on {PHONE} after lunch.
Text me at {PHONE}
Ring {PHONE} and ask for {NAME}.
{NAME}, {PHONE}
Fax {PHONE}
Telefon: {PHONE}
Mon téléphone : {PHONE}
Mi móvil es el {PHONE}.
whatsapp {PHONE} pls
I tried {PHONE} but nobody picked up.
{NAME} ({PHONE}) is the emergency contact.
Her new mobile is {PHONE}; the old one is dead.
Dial {PHONE} from abroad.
My email is {EMAIL}.
Email: {EMAIL}
Send the documents to {EMAIL}, please.
{NAME} <{EMAIL}> wrote:
cc {EMAIL}
You can reach me under {EMAIL} or {PHONE}.
Contact {EMAIL} for details.
Schreiben Sie an {EMAIL}.
Écrivez à {EMAIL} svp.
his address is {EMAIL} I think
Unsubscribe {EMAIL} from the list.
forwarded by {EMAIL} on Tuesday
My social security number is {ID_NUMBER}.
SSN: {ID_NUMBER}
Passport no. {ID_NUMBER}
Passport number {ID_NUMBER}, issued last year.
Tax ID {ID_NUMBER}
National ID: {ID_NUMBER}
His insurance number, {ID_NUMBER}, was wrong.
Personalausweis {ID_NUMBER}
Steuernummer: {ID_NUMBER}
Numéro de sécurité sociale {ID_NUMBER}
DNI {ID_NUMBER}
Driving licence {ID_NUMBER} belongs to {NAME}.
{NAME}, health insurance {ID_NUMBER}, waits in room two.
The clerk typed {ID_NUMBER} as the identity number of {NAME}.
Enter the taxpayer number ({ID_NUMBER}) on page one.
I live at {ADDRESS}.
Address: {ADDRESS}
Please deliver it to {ADDRESS}.
{NAME}
{ADDRESS}
Our new home is {ADDRESS}, come and visit.
He moved from {ADDRESS} to {ADDRESS}.
Ich wohne in der {ADDRESS}.
J'habite au {ADDRESS}.
Vivo en {ADDRESS}.
The party is at {ADDRESS}; bring a cake.
Bill to: {NAME}, {ADDRESS}
They met outside {ADDRESS} at noon.
""".strip().splitlines()

WITHOUT = """
The quarterly report is due on Friday.
Order {n8} has been shipped.
Invoice no. {n6} dated {date} is still unpaid.
Version {n1}.{n2}.{n1} fixes the crash.
Error {n4} at line {n3}.
The server at {ip} did not respond.
Tracking number {track}
ISBN 978-{n1}-{n4}-{n4}-{n1}
Meeting ID: {n3} {n3} {n4}
Ticket #{n6} was closed by the bot.
The coordinates are {n2}.{n6}, {n2}.{n6}.
The total comes to {n1},{n3},{n3} dollars.
It took {n3} hours and cost {n1} {n3} {n3} euros.
Commit {hex} broke the build.
Session {uuid} expired.
IBAN placeholder DE{n2} {n4} {n4} {n4} {n4} {n2} is a company account.
Serial number {L}{n8} of the printer.
Part {L}{L}-{n4}-{n2} is out of stock.
Flight {L}{L} {n4} leaves at gate {n2}.
The checksum is {n3}-{n2}-{n4}.
Batch {n3}-{n3}-{n4} failed the test.
Reference {n4}-{n4}-{n4}
Article {n3}.{n3}.{n4} in the catalogue.
Date: {date}, time {n2}:{n2}
Between 19{n2} and 20{n2} the population grew by {n3}.
{Org} announced a new product.
{Org} was founded in 19{n2}.
I work for {Org} in {Place}.
We bought it from {Org} last year.
The offices of {Org} in {Place} are closed.
A spokesman for {Org} declined to comment.
{Place} is a town near {Place}.
The train from {Place} to {Place} was late.
Welcome to {Place}!
We spent the summer in {Place} and the winter in {Place}.
The weather in {Place} is terrible in November.
Hurricane {Given} hit the coast.
The good ship {Given} sank in 18{n2}.
The {Given} Hotel has {n3} rooms.
Café {Given} opens at nine.
{Family} Street is closed for repairs.
{Family} Motors recalled {n4} cars.
The {Family} Foundation supports schools.
The {Family} effect is described in chapter {n1}.
Saint {Given} Church was built in 17{n2}.
Visit the {Family} Museum in {Place}.
The Annual Report and the Technical Summary are attached.
The Ministry of Finance published new rules.
New York and San Francisco are far apart.
The United Nations met in Geneva.
On Monday, Tuesday and Wednesday we are closed.
In January it snowed; by April everything was green.
Merry Christmas and a Happy New Year!
English, French and German are spoken here.
The Great Wall is visible from the road.
Chapter One: The Beginning
Terms and Conditions apply.
Project Falcon starts in March.
Our Python code runs on Linux and Windows.
Google Maps shows another route.
Open Settings, then Privacy, then Cookies.
The Star Tribune and the Morning Post wrote about it.
Please mention @{low} in the channel.
Install {low}@{n1}.{n1}.{n1} from the registry.
The handle is @{low}_{n2}.
Use user@host only as a placeholder for ssh.
See you at eight dot at the corner.
Look at {low} dot for help.
There is nothing at all in the box.
Room {n3}, second floor, turn left.
Road works on route {n2} until May.
The street was empty and the lane was dark.
{n2} Squadron flew over the avenue of trees.
Highway {n3} is closed.
Take {n1} tablets every {n2} hours.
Add {n3} grams of flour and {n1} eggs.
Chapter {n2}, page {n3}.
Call me maybe.
Nobody answered the phone, so I left.
Someone forgot an umbrella in the hall.
Thanks a lot!
ok
sounds good, see you tomorrow
Reading this again, I agree with every word.
Everything worked after the update.
Nothing to report today.
Somewhere in the archive there is a copy.
Grandmother made soup on Sundays.
Neighbours complained about the noise.
Researchers found water on Mars.
Customers can return goods within {n2} days.
Students must register before September.
Critical Path and Root Cause are on the agenda.
Das Wetter in {Place} war schön.
Die Firma {Org} hat geschlossen.
Der Zug nach {Place} fährt um {n2} Uhr.
La gare de {Place} est fermée.
La empresa {Org} está en {Place}.
Il treno per {Place} parte alle {n2}.
I will rose early, mark my words, and bill nobody.
May I ask for a grant? Grace is a virtue, hope too.
The {Org} {Place} branch has {n3} employees.
GET /api/v{n1}/items?id={n8} returned {n3}
| {n3} | {n4} | {n2}% |
{{"id": {n8}, "status": "ok"}}
<div class="{low}">{n2}</div>
SELECT count(*) FROM {low} WHERE id = {n6};
Phase {n1} of the {Place} Tunnel costs {n3} million.
Model {L}{n3} replaces model {L}{n2}.
License plate {L}{L} {n4} was parked outside.
Account {n4} of the club, reference {n8}.
Lot {n8}, best before {date}.
The case number is {n4}/{n2}.
The old road to {Place} is flooded.
Compared with {Place}, rents here are low.
She wrote a book about {Place} and its canals.
There is no news from {Place} yet.
Trade with {Place} doubled in 18{n2}.
How far is {Place} from {Place}?
What do people in {Place} eat?
Did {Place} win the cup?
Few tourists know {Place}, and fewer go there.
After {Place} the river turns north.
{Place} and {Place} share a fire brigade.
A parcel was sent to {Place} by mistake.
We never saw {Place} again.
Photographs of {Place} hang in the corridor.
Why did {Org} sell its harbour?
Everything that {Org} makes is blue.
The contract with {Org} ends soon.
Ask {Org} for a refund.
Which engine does {Org} use for its boats?
Shares of {Org} and {Org} fell.
{Org} bought {Org} in 20{n2}.
The merger of {Org} with {Org} was stopped.
He has worked at {Org} since 19{n2}.
Letters to {Org} remain unanswered.
In 19{n2} the {Family} Road was paved.
The {Place} Festival begins in {n2} days.
Parts from {Org} arrived at {Place}.
My train stopped at {Place} for an hour.
Tell me more about {Place}.
Remember that {Org} owns the mill.
""".strip().splitlines()

_SYLLABLES = "ba be bo da de di do fa fe ga go ha he hi ja jo ka ke ki ko la le li lo lu ma me mi mo na ne ni no pa pe ra re ri ro ru sa se si so ta te ti to va ve vi wa wo za zo an en in on ar er or al el ul am em um ist und ost ark elm".split()
_KINDS = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME")


class _Maker:
    """Random items in public formats; names of the half that is asked for, or invented ones."""

    def __init__(self, seed: int, held_out: bool | None) -> None:
        self.r, self.half = random.Random(seed), None if held_out is None else int(held_out)

    def digits(self, pattern: str) -> str:
        """``#`` becomes a digit, ``@`` a capital letter, ``*`` either."""
        put = {"#": "0123456789", "@": "ABCDEFGHJKLMNPRSTUVWXYZ", "*": "0123456789CFGHJKLMNPRTVWXYZ", "+": "+"}
        return "".join(self.r.choice(put[c]) if c in "#@*" else c for c in pattern)

    def invented(self, least: int = 2, most: int = 3) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(least, most))) + self.r.choice("n r s t l k m a o e".split())

    def of(self, words: list[str]) -> str:
        return self.r.choice([w for i, w in enumerate(words) if self.half is None or (i // 2) % 2 == self.half])

    def given(self) -> str:
        return (self.of(GIVEN_NAMES) if self.r.random() < 0.6 else self.invented(1, 2)).capitalize()

    def family(self) -> str:
        w = self.of(FAMILY_NAMES) if self.r.random() < 0.35 else self.invented(1, 3) + self.r.choice(("", "", "son", "er", "ez", "ski", "mann", "berg", "ton", "ini", "ov", "sen", "ley"))
        return w.title().replace("'S", "'s") if "'" in w else w.capitalize()

    def NAME(self) -> str:  # noqa: N802
        r, g, f, x = self.r, self.given(), self.family(), self.r.random()
        initial = r.choice("ABCDEFGHJKLMNPRSTW") + "."
        if x < 0.16:
            name = g
        elif x < 0.20:
            name = f
        elif x < 0.28:
            name = f"{f}, {g}" + (f" {initial}" if r.random() < 0.2 else "")
        elif x < 0.36:
            name = f"{initial} {f}"
        elif x < 0.40:
            name = f"{initial} {r.choice('ABDEJM')}. {f}"
        elif x < 0.48:
            name = f"{g} {initial} {f}"
        elif x < 0.56:
            name = f"{g} {r.choice(('van', 'van der', 'von', 'de', 'de la', 'del', 'di', 'da', 'al', 'ben', 'le', 'ter', 'dos', 'zu'))} {f}"
        elif x < 0.60:
            name = f"{g} {self.given()} {f}"
        elif x < 0.64:
            name = f"{g} {f}-{self.family()}"
        elif x < 0.66:
            name = f"{g} {f[0]}."
        else:
            name = f"{g} {f}"
        y = r.random()
        return name.upper() if y < 0.06 and ". " not in name else name.lower() if y < 0.13 and "." not in name and g.lower() in GIVEN_NAMES else name

    def EMAIL(self) -> str:  # noqa: N802
        r = self.r
        plain = lambda w: re.sub(r"[^a-z]", "", w.lower()) or "x"
        g, f = plain(self.given()), plain(self.family())
        local = r.choice((g, f, f"{g}.{f}", f"{g[0]}.{f}", f"{g}{f}", f"{g[0]}{f}", f"{f}_{g}", f"{g}-{f}", f"{g}{r.randrange(1, 100)}", f"{f}{r.randrange(1940, 2015)}", f"{g}.{f}+{r.choice(('news', 'shop', 'work'))}"))
        site = plain(self.invented(1, 3))
        domain = r.choice((f"{site}.com", f"{site}.org", f"{site}.net", f"{site}.de", f"{site}.co.uk", f"mail.{site}.fr", f"{site}.example", f"{site}.test", f"{site}-{plain(self.invented(1, 1))}.info", "example.com", "example.org"))
        x = r.random()
        if x < 0.12:
            return f"{local}{r.choice((' at ', ' AT ', ' (at) ', ' [at] ', '(at)', '[at]'))}{domain.replace('.', r.choice((' dot ', ' [dot] ', ' (dot) ', '.')))}"
        mail = f"{local}@{domain}"
        return mail.upper() if x < 0.17 else mail.title() if x < 0.20 else mail

    def PHONE(self) -> str:  # noqa: N802
        r = self.r
        phone = self.digits(
            r.choice(
                """(###) ###-####|###-###-####|###.###.####|### ### ####|+1 ### ### ####|+1-###-###-####|+1 (###) ###-####|1-800-###-####|020 #### ####|0#### ######|07### ######|+44 20 #### ####
                +44 7### ######|+44 (0)20 #### ####|0044 20 #### ####|00447#########|030 #######|0171 #######|0171/#######|089/######|+49 30 #######|+49 (0)89 ######|+4917########|0# ## ## ## ##
                +33 # ## ## ## ##|9## ### ###|+34 6## ### ###|+39 0# #### ####|+91 ##### #####|06-########|0#-####-####|+81 3 #### ####|+48 ### ### ###|+### ## ### ## ##|##########|+##########|+55 11 #####-####""".replace("\n", "|").replace("|                ", "|").split("|")
            )
        )
        return phone.replace("-", r.choice("\u2011\u2013")) if r.random() < 0.05 else phone.replace(" ", "\u00a0") if r.random() < 0.04 else phone

    def ID_NUMBER(self) -> str:  # noqa: N802
        return self.digits(
            self.r.choice(
                """###-##-####|###-##-####|9##-##-####|@@ ## ## ## @|@@######@|########@|@#######@|#########|@########|@@#######|@#########|## ### ### ###|###########|# ## ## ## ### ### ##|######-####
                756.####.####.##|###.###.###-##|###-###-###|#### #### ####|@@@@@####@|@@@@@@##@##@###@|*###-*@#-@@##|#### ##### #|@##*##*##|######/####|######## @""".replace("\n", "|").replace("|                ", "|").split("|")
            )
        )

    def town(self) -> str:
        return self.invented(1, 2).capitalize() + self.r.choice(["", "", "", *"ton ville burg field stad heim ham bridge ford port mouth wick dorf haven holm by minster combe ness stead mont polis grad pur ia bach".split()])

    def ADDRESS(self) -> str:  # noqa: N802
        r, n = self.r, self.r.randrange(1, 400)
        name, town = (self.family() if r.random() < 0.5 else self.invented(1, 2).capitalize()), self.town()
        kind = r.choice("Street Road Lane Avenue Drive Close Court Way Square Terrace St. Rd Ave. Ave Ln Dr. Place Boulevard Crescent".split())
        street = f"{n}{r.choice(('', '', '', 'a', 'B'))} {r.choice(('', '', '', 'N ', 'W. ', 'Old ', 'Upper '))}{name} {kind}"
        post, state = f"{r.randrange(10000, 99999)}", r.choice("CA NY TX IL WA FL OH".split())
        uk = self.digits(r.choice(("@# #@@", "@@# #@@", "@## #@@")))
        german = f"{name}{r.choice(('straße', 'strasse', 'str.', 'weg', 'allee', 'platz', 'gasse', 'ring'))} {n}{r.choice(('', '', 'a', ' b'))}"
        where = lambda rest: r.choice((f"{rest[0]}, {rest[1]}", f"{rest[0]}, {rest[1]}", f"{rest[0]}\n{rest[1]}"))
        made = r.choice(
            (
                street, f"{street}, {town}", where((street, f"{town} {post}")), f"{street}, {town}, {state} {post}", where((street, f"{town} {uk}")),
                f"{r.choice(('Flat', 'Apt', 'Apartment', 'Unit', 'Suite'))} {r.randrange(1, 60)}{r.choice(('', 'A', 'C'))}, {street}, {town}", f"{street}, {r.choice(('Apt', 'Unit', 'Suite'))} {r.randrange(1, 60)}, {town}",
                german, where((german, f"{post} {town}")), where((german, f"{post} {town}")),
                where((f"{n}{r.choice(('', '', ' bis', ' ter'))} {r.choice(('rue', 'avenue', 'boulevard', 'place', 'chemin'))} {r.choice(('de ', 'du ', 'des ', 'de la ', ''))}{name}", f"{post} {town}")),
                where((f"{r.choice(('Calle', 'Avenida', 'Plaza', 'Paseo'))} {r.choice(('', 'de ', 'del ', 'de la '))}{name} {n}{r.choice(('', f', {r.randrange(1, 7)}º {r.choice('ABC')}'))}", f"{post} {town}")),
                where((f"{r.choice(('Via', 'Piazza', 'Viale', 'Corso'))} {name} {n}", f"{post} {town}")),
            )
        )
        return made.upper() if r.random() < 0.05 else made

    def org(self) -> str:
        """A name of its own, sometimes a trade, sometimes a legal form, at least one of them."""
        r = self.r
        own = r.choice((self.family(), self.invented().capitalize(), self.given(), self.town()))
        trade = r.choice("Bank Group Holdings Industries Systems Labs Partners University Institute Foundation Motors Airlines Software Media Energy Logistics Hospital College Consulting Foods Pharma Robotics Aviation Electronics Mining Press Museum Brothers Company Association Insurance Chemicals Shipping Furniture Trading".split())
        legal = r.choice("Inc Ltd GmbH AG Corp LLC S.A. B.V. S.p.A. Co. plc KG Foundation Cooperative".split())
        return " ".join((own, *r.choice(((trade,), (legal,), (trade, legal), (trade, legal), (r.choice(("Marine", "Medical", "General", "Digital")), trade)))))

    def plain(self, line: str) -> str:
        r = self.r
        put = {
            "n1": lambda: self.digits("#"), "n2": lambda: self.digits("##"), "n3": lambda: self.digits("###"), "n4": lambda: self.digits("####"), "n6": lambda: self.digits("######"), "n8": lambda: self.digits(r.choice(("#######", "########", "##########"))),
            "L": lambda: self.digits("@"), "hex": lambda: f"{r.getrandbits(r.choice((28, 64, 128, 160))):x}", "low": lambda: self.invented().lower(), "ip": lambda: ".".join(str(r.randrange(1, 255)) for _ in range(4)),
            "date": lambda: r.choice((f"{r.randrange(1950, 2030)}-{r.randrange(1, 13):02d}-{r.randrange(1, 29):02d}", f"{r.randrange(1, 29)}/{r.randrange(1, 13)}/{r.randrange(1950, 2030)}", f"{r.randrange(1, 29):02d}.{r.randrange(1, 13):02d}.{r.randrange(1950, 2030)}")),
            "track": lambda: self.digits(r.choice(("1Z###@##############", "@@#########@@", "#### #### #### ####"))), "uuid": lambda: "-".join(f"{r.getrandbits(4 * k):0{k}x}" for k in (8, 4, 4, 4, 12)),
            "Place": self.town, "Given": self.given, "Family": self.family,
            "Org": self.org,
        }
        return re.sub(r"\{(\w+)\}", lambda m: put[m[1]](), line).replace("{{", "{").replace("}}", "}")


#: Words of the sentences that stand for things with a name of their own.
_PROPER = frozenset("annual technical summary ministry finance francisco united nations geneva merry christmas english french german great wall falcon python linux windows google maps star tribune morning post monday tuesday wednesday friday january april november june september saint mars york wetter firma zug uhr büro telefon personalausweis steuernummer dni ssn iban isbn".split())


def ordinary_words() -> set[str]:
    """Lower-cased words of all sentences but the proper ones: a stand-in for the usual words of a corpus."""
    lines = re.sub(r"\{\w+\}", " ", " ".join([*WITH_ITEMS, *WITHOUT]))
    return {w for w in re.findall(r"[^\W\d_]{2,}", lines.lower())} - _PROPER


def compose(texts: int, seed: int, held_out: bool | None = False) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
    """Texts of one to four sentences with the spans of their items; ``held_out`` None takes both halves."""
    m = _Maker(seed, held_out)
    mine = lambda lines: [s for i, s in enumerate(lines) if held_out is None or (i % 3 == 2) == held_out]
    good, bad = mine(WITH_ITEMS), mine(WITHOUT)
    for _ in range(texts):
        text, spans = "", []
        for _ in range(m.r.choice((1, 1, 2, 2, 3, 4))):
            if text:
                text += m.r.choice(("\n", "\n\n", "  ", "\t")) if m.r.random() < 0.15 else " "
            if m.r.random() < 0.5:
                text += m.plain(m.r.choice(bad))
                continue
            for part in re.split(r"(\{[A-Z_]+\})", m.r.choice(good)):
                if (kind := part.strip("{}")) in _KINDS and part[:1] == "{":
                    item = getattr(m, kind)()
                    spans.append((len(text), len(text) + len(item), kind))
                    text += item
                else:
                    text += part
        if m.r.random() < 0.04:
            text = "".join(c.upper() if len(c.upper()) == 1 else c for c in text)
        yield text, spans
