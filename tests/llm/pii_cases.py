"""Mentions in wording of its own, written before the detector was trained: [kind|mention] marks a mention, the rest is plain text."""

import re

EMAIL, PHONE, ID, PLACE, NAME = "email", "phone", "id_number", "street_address", "person_name"
_NAMES = (
    "Siobhan O'Connor", "Liam McCarthy", "Jürgen Müller", "Jean-Luc Moreau", "José García López", "Łukasz Wójcik", "Anders Sørensen", "Giulia D'Angelo", "Ludwig van Dijk", "Priyanka Chatterjee",
    "Tomáš Dvořák", "Ingrid Åkesson", "Иван Петров", "Mary-Ann Fitzgerald", "Kwame Mensah", "Dmitri Sokolov", "Chloé Lefèvre", "Björn Þórsson", "Beatriz de la Cruz", "Harold P. Whitcombe",
)
_PHONES = ("+33 6 12 34 56 78", "+44 20 7946 0958", "(212) 555-0147", "0171 5550 123", "+86 138 0013 8000", "+1-303-555-0182", "020 7946 0321", "+34 912 345 678", "+49 (0)30 901820", "415.555.0133")
_IDS = (("SSN", "078-05-1120"), ("passport", "C01X00T47"), ("national insurance number", "AB 12 34 56 C"), ("DNI", "12345678-Z"), ("tax ID", "86 095 742 719"), ("NIE", "X1234567L"), ("passport number", "P4366918"), ("social security number", "219 09 9999"))
_PLACES = ("12 Harbour Esplanade", "221B Baker Street, London", "7 Rue de la Paix", "48 Maple Avenue, Apt 5", "Hauptstraße 12, 10115 Berlin", "Calle de Alcalá 50, Madrid", "Flat 2, 9 Queen's Road", "1600 Amphitheatre Parkway", "Kirchweg 7a", "350 Fifth Avenue, New York")
_EMAILS = ("liam.mc@fastmail.example", "siobhan_oc@uni.example.ie", "j.mueller (at) firma (dot) de", "priyanka [at] lab [dot] org", "post@akesson.example", "DVORAK@FIRMA.EXAMPLE", "k.mensah+news@mail.example.com", "chloe at maison dot fr")

_FRAMES = (
    "Yesterday the nurse phoned {n} twice on {p}, without luck.",
    "Our new tenant, {n}, moved into {a} last June.",
    "If the courier gets lost, he should dial {p}.",
    "I wrote down {e} because the card was torn.",
    "For the visa we still lack {n}'s passport copy.",
    "The {i} given by the applicant was checked by the clerk.",
    "Could {n} bring the keys tomorrow? Otherwise write to {e}.",
    "Minutes taken by {n}; apologies from {n}.",
    "According to {n}, the invoice went to {a}.",
    "My landlord's number changed to {p} in March.",
    "Deliver flowers to {a} before noon, please.",
    "The surgeon, Dr. {n}, will see you at ten.",
    "Registered under {i} and living at {a}, she voted by mail.",
    "Subscribe with {e} or text {p}.",
    "Best regards\n{n}\n{p}",
    "Witness statement of {n}, taken at {a}.",
    "Claimant: {n}; {i}; phone {p}",
    "We invited {n} and {n} to the wedding.",
    "Lost wallet: please write to {e}, reward offered.",
    "Der Vertrag mit {n} endet im Mai, Rückfragen unter {p}.",
    "El paquete para {n} sigue en {a}.",
    "Attendees were {n}, {n} and a guest.",
    "She forwarded everything to {e} at midnight.",
    "He was born as {n} and never changed it.",
)
#: Nothing of this is personal.
PLAIN = (
    "The Silver Lake initiative starts on Monday with twelve people.", "Section 4, Market Outlook, was cut by half.", "Flight 4471 boards at gate 12 at 18:45.", "We sold 12,450 units for 99.50 each in 2023.",
    "The server at 192.168.10.24 answered after 350 ms.", "Parcel tracking 1Z-999-884 arrived.", "Room 12 West Wing is closed.", "Mercury and Venus were visible on 2024-03-12.", "Use git@ as prefix and meet at dawn.",
    "The Golden Gate Bridge opened in 1937.", "ISBN 978-3-16-148410-0 is out of print.", "Season 3 Episode 12 was the best one.", "In New York it rained for 40 days.", "The Great Wall is 21196 km long.", "Run 20240312-77 finished; exit code 137.",
    "Our Quarterly Planning Review covers Budget Control and Risk.", "Article 12 Freedom Of Movement was quoted.", "The Ministry of Health published Table 14.", "Item 44-120-9 costs 15 euros.", "See @maria_dev for the pull request 88123.",
)


def cases() -> list[tuple[str, set[tuple[str, int, int]]]]:
    """(text, mentions): every frame with six different fillings, and the plain texts."""
    pools = {"n": [(NAME, x) for x in _NAMES], "p": [(PHONE, x) for x in _PHONES], "i": _IDS, "a": [(PLACE, x) for x in _PLACES], "e": [(EMAIL, x) for x in _EMAILS]}
    used = dict.fromkeys(pools, 0)
    out = []
    for turn in range(6):
        for frame in _FRAMES:
            text, spans = "", set()
            for part in re.split(r"(\{\w\})", frame):
                if not part.startswith("{"):
                    text += part
                    continue
                pool = pools[part[1]]
                kind, mention = pool[(used[part[1]] + turn) % len(pool)]
                used[part[1]] += 1
                if part[1] == "i":
                    text += f"{kind} "
                    kind = ID
                spans.add((kind, len(text), len(text) + len(mention)))
                text += mention
            out.append((text, spans))
    return out + [(t, set()) for t in PLAIN]
