"""A made-up Romanian corpus: four chapters of one-verse facts in several sentence shapes."""

NAMES = ["Samuel", "David", "Saul", "Ionatan", "Abner", "Ioab", "Natan", "Absalom", "Ana", "Penina", "Eli", "Goliat", "Isai", "Domnul"]
DEEDS = ["a adus grâu din câmpul cel mare", "a zidit o casă lângă poarta cetății", "a chemat poporul la munte", "a trimis daruri scumpe preoților", "a păzit turma toată noaptea", "a citit legea înaintea adunării", "a trecut râul spre dimineață", "a găsit o fântână veche", "a cântat psalmi de laudă", "a cumpărat un ogor roditor", "a deschis porțile templului", "a scris o carte despre judecători", "a plantat măslini pe deal", "a împărțit prada cu oștenii", "a vindecat un orb la marginea satului", "a cerut apă de la străini", "a ridicat o piatră de aducere aminte", "a făcut pace cu vecinii", "a numărat oștenii din tabără"]
ENDS = ["cu mare bucurie", "fără nicio teamă", "în luna a treia", "după multe zile", "la porunca regelui", "spre seară târziu", "cu toată casa sa"]
PLACES = ["Silo", "Rama", "Hebron", "Betleem", "Gat", "Ecron"]
COUNTS = ["trei", "cinci", "șapte", "zece", "patru"]


def verse(n: int) -> str:
    name, other = NAMES[n % len(NAMES)], NAMES[(n * 5 + 3) % len(NAMES)]
    deed, end = DEEDS[(n * 7 + n // 14) % len(DEEDS)], ENDS[(n * 3 + n // 19) % len(ENDS)]
    if n % 6 == 5:
        return f"Atunci oamenii din {PLACES[n % 6]} au primit {COUNTS[n % 5]} corăbii noi {end} și {deed.split(' ', 1)[1]}."
    if n % 6 == 4:
        return f"Solii veniți târziu au vorbit mult despre {name} {end}. Preotul bătrân {deed} {end}."
    if n % 6 == 3:
        return f"În anul acela bogat {name} {deed} {end}, iar bătrânii cetății au lăudat fapta bună."
    return f"Regele {name} {deed} {end}. Toți oamenii locului au cinstit fapta lui {other}."


def markdown(chapters: int = 4, verses: int = 30) -> str:
    """Headings begin paragraphs, one of them inside a verse; some verses run over lines."""
    lines, n = ["# Cartea de probă"], 0
    for c in range(chapters):
        lines += ["", f"Titlul capitolului, partea {'abcdefgh'[c]}"]
        for v in range(1, verses + 1):
            text = verse(n)
            if n % 17 == 3:
                first, rest = text.split(" ", 1)
                lines += [f"{v} {first}", "", "Un titlu în mijloc", rest]
            elif n % 13 == 5:
                lines += [f"{v} " + text.replace(" cu ", "\n  cu ", 1).split("\n")[0], *(text.replace(" cu ", "\n  cu ", 1).split("\n")[1:])]
            else:
                lines.append(f"{v} {text}")
            n += 1
    return "\n".join(lines) + "\n"
