"""Sentence forms that the training texts do not have, to measure what the field makes of other wording."""

HELD_OUT = {
    "en": """The lost dog belongs to <N>, who can be called at <P>.
Witnesses saw <N> leave the bakery shortly before <H>.
Return the forms to <A> or scan them to <E>.
Applicant number <R> is <N>, citizen number <I>.
Two tickets are held at the desk for <N>.
Our landlady, <N>, died in <T> at the age of <n>.
After the flood <N> rebuilt the shop at <A> with <X>.
In case of emergency dial <P> and mention room <n>.
The winner is <N> with <n> points, followed by <N>.
Visa holder <I> crossed the border near <T> on <D>.
Everyone at <F> remembers how <N> sang.
Drafts should be mailed to <E> no later than <D>.""",
    "de": """Der entlaufene Hund gehört <N>, erreichbar unter <P>.
Zeugen sahen <N> kurz vor <H> aus der Bäckerei kommen.
Formulare bitte an <A> schicken oder an <E> mailen.
Zwei Karten sind an der Kasse für <N> hinterlegt.
Nach dem Hochwasser hat <N> den Laden in der <A> neu gebaut.
Im Notfall <P> anrufen und Zimmer <n> nennen.
Gewonnen hat <N> mit <n> Punkten vor <N>.
Das Visum <I> galt nur bis <D>.""",
    "fr": """Le chien perdu est à <N>, joignable au <P>.
Des témoins ont vu <N> sortir de la boulangerie vers <H>.
Renvoyez les formulaires au <A> ou par mail à <E>.
Deux billets attendent <N> à la caisse.
Après la crue, <N> a rebâti la boutique du <A>.
En urgence, faites le <P> et donnez la chambre <n>.
La gagnante est <N> avec <n> points, devant <N>.
Le visa <I> expirait le <D>.""",
    "es": """El perro perdido es de <N>, localizable en el <P>.
Unos testigos vieron a <N> salir de la panadería hacia las <H>.
Devuelva los impresos a <A> o envíelos a <E>.
Hay dos entradas guardadas para <N> en la taquilla.
Tras la riada, <N> rehízo la tienda de <A>.
En una urgencia llame al <P> y diga la habitación <n>.
Ganó <N> con <n> puntos, por delante de <N>.
El visado <I> caducaba el <D>.""",
    "nl": """De weggelopen hond is van <N>, bereikbaar via <P>.
Getuigen zagen <N> rond <H> de bakkerij uit komen.
Stuur de formulieren naar <A> of mail ze naar <E>.
Bij de kassa liggen twee kaartjes klaar voor <N>.
Na de overstroming bouwde <N> de winkel aan de <A> weer op.
Bel in nood <P> en noem kamer <n>.
Winnaar is <N> met <n> punten, voor <N>.
Het visum <I> liep af op <D>.""",
    "ru": """Потерявшуюся собаку ищет <N>, звоните <P>.
Свидетели видели, как <N> выходит из булочной около <H>.
Бланки верните по адресу <A> или пришлите на <E>.
В кассе отложены два билета, их заберёт <N>.
После наводнения <N> заново построил лавку по адресу <A>.
При аварии набирайте <P> и назовите комнату <n>.
Победила <N>, <n> очков, на втором месте <N>.
Виза <I> действовала до <D>.""",
}


def held_out() -> dict[str, list[str]]:
    return {lang: forms.split("\n") for lang, forms in HELD_OUT.items()}
