"""Words of the closed classes in the six languages of the training texts: articles, pronouns, prepositions,
conjunctions, auxiliaries, frequent adverbs. They tell where a name begins and ends in a sentence whose other words
nobody has seen. Particles of names are a class of their own, since they stand in names as well."""

WORDS = {
    "en": """a an the this that these those i you he she it we they me him her us them my your his its our their mine yours ours theirs who whom whose which what where when why how
        and or but nor so yet for if unless until while although though because since as than whether after before once in on at by to of from with without within into onto upon over under
        above below between among through during against about across along around behind beside beyond near off out up down toward towards per via except despite like
        is are was were be been being am do does did done have has had having can could shall should would might must ought not no yes never always often sometimes ever still already
        just only even also too very quite rather almost then there here now again soon later today tomorrow yesterday some any each every all both either neither none many much few more most
        less least other another such same own two three five seven eight nine last next please let both nobody everyone someone anyone nothing something
        everything it's don't doesn't didn't isn't wasn't won't can't couldn't wouldn't i'm you're we're they're i've we've there's that's perhaps maybe however therefore thus""",
    "de": """der die das den dem des ein eine einen einem einer eines kein keine keinen dieser diese dieses diesen diesem jener jede jeder jedes jeden welche welcher welches ich du er sie es wir ihr
        mich dich sich uns euch mir dir ihm ihn ihnen mein meine meinen meiner dein deine sein seine seinen seiner unser unsere unseren ihre ihren ihrer ihrem wer wen wem was wo wann warum wie
        und oder aber denn sondern wenn falls ob dass weil da während obwohl damit bevor nachdem seit bis als in im ins an am auf aus bei beim mit nach von vom zu zum zur über unter vor hinter
        neben zwischen durch für gegen ohne um trotz wegen laut statt gegenüber ab ist sind war waren sei wäre bin bist seid wird werden wurde wurden worden hat haben hatte hatten habe kann können
        konnte muss müssen musste soll sollen sollte wollen wollte darf dürfen mag möchte nicht nein ja nie immer oft manchmal noch schon nur auch sehr ganz fast dann dort hier jetzt wieder
        bald später heute morgen gestern einige alle beide viele viel wenig mehr weniger andere anderen man niemand jemand nichts etwas alles bitte liebe lieber zwei drei vier fünf sechs sieben acht neun zehn
        letzte letzten nächste doch also so dabei davon dazu daran deshalb darum jedoch zwar eben gar hätte würde""",
    "fr": """le la les l' un une des du de d' au aux ce cet cette ces je tu il elle on nous vous ils elles me te se lui leur leurs mon ma mes ton ta tes son sa ses notre nos votre vos qui que qu' quoi
        dont où quand pourquoi comment combien quel quelle quels quelles et ou mais donc or ni car si lorsque puisque comme parce afin à en dans sur sous avec sans pour par contre entre vers chez
        depuis pendant avant après devant derrière jusque jusqu'à dès hors selon malgré sauf est sont était étaient être été sera serait suis es êtes a as ai ont avait avaient avoir eu aura fait
        faut faut-il peut peuvent pouvait doit doivent devait veut va vont ne pas plus jamais toujours souvent encore déjà seulement aussi très trop peu presque puis alors là ici maintenant bientôt
        aujourd'hui demain hier quelques tous tout toute toutes chaque aucun aucune plusieurs autre autres même mêmes personne rien quelqu'un oui non cher chère
        dernier dernière y c'est n'est qu'il qu'elle s'il est-ce est-il a-t-il y-a-t-il j'ai d'un d'une l'on merci ainsi cependant""",
    "es": """el la los las lo un una unos unas del al de este esta esto estos estas ese esa eso esos aquel aquella yo tú él ella ello nosotros ustedes usted ellos ellas me te se nos le les mi mis tu tus
        su sus nuestro nuestra nuestros vuestro quien quién que qué cual cuál cuyo donde dónde cuando cuándo por porque cómo como cuánto y e o u pero sino ni si aunque mientras pues en a con sin
        para sobre bajo entre hacia hasta desde durante contra según ante tras mediante salvo es son era eran fue fueron ser sido será sería soy está están estaba estar estado hay había haber ha
        han he hemos tiene tienen tenía puede pueden podía debe deben debía quiere va van no sí nunca siempre aún todavía ya solo sólo también tampoco muy más menos mucho poco casi
        luego después antes allí aquí ahora pronto hoy mañana ayer algunos algunas todo toda todos todas cada ningún ninguna varios otro otra otros otras mismo misma nadie alguien nada algo tres cuatro cinco siete nueve diez
        último última querido querida entonces así quizá""",
    "nl": """de het een dit dat deze die ik jij je u hij zij ze wij we jullie mij me hem haar ons hen hun mijn jouw zijn onze uw wie wat waar wanneer waarom hoe welke en of maar want dus noch als indien
        omdat doordat terwijl hoewel zodat voordat nadat sinds tot toen in op aan bij met naar van voor door over onder boven tussen tegen zonder om uit achter naast langs per volgens tijdens ondanks
        wegens binnen buiten is bent was waren wordt worden werd werden geweest heeft hebben had hadden heb kan kunnen kon moet moeten moest zal zullen zou wil willen wilde mag mogen mocht niet geen
        nee ja nooit altijd vaak soms nog al alleen ook zeer heel erg bijna dan daar hier nu weer straks later vandaag morgen gisteren enkele alle beide veel weinig meer minder andere ander elke elk
        ieder iedere men niemand iemand niets iets alles twee drie vier vijf zes zeven acht negen tien laatste volgende te er toch zo ervan daarvan daarom echter misschien beste""",
    "ru": """я ты он она оно мы вы они меня тебя его её нас вас их мне тебе ему ей нам вам им мной тобой себя мой моя моё мои твой твоя свой своя свои наш наша наши ваш ваша ваши этот эта это эти тот та
        те кто что где когда почему зачем как какой какая какие чей куда откуда сколько и или но а да не ни же ли бы если чтобы потому хотя пока раз в во на у к ко с со о об от до из изо за над под
        перед при про через без для по между среди около против ради кроме вокруг после вместо из-за из-под был была было были есть будет будут быть нет никогда всегда часто иногда ещё уже только
        также тоже очень почти потом там тут здесь теперь сейчас снова скоро позже сегодня завтра вчера некоторые все всё всех каждый каждая много мало больше меньше другой другая другие сам сама
        никто кто-то ничего что-то один одна два две три четыре пять шесть семь восемь девять десять последний может можно нельзя надо нужно должен должна то так вот даже разве""",
}
PARTICLES = frozenset("von van der den de la del da di du do des ter te le el al zu zur zum bin ibn ben af av und y e".split())
FUNCTION = frozenset(w for words in WORDS.values() for w in words.split()) - PARTICLES


def word_class(low: str) -> str:
    """f: of a closed class, p: a particle of names, empty: any other word. Parts joined by a hyphen count by their ."""
    if low in PARTICLES:
        return "p"
    return "f" if low in FUNCTION or ("-" in low and low.split("-")[0] in FUNCTION and low.rsplit("-", 1)[1] in FUNCTION) else ""
