"""Labelled training texts for the field that finds personal values: texts of six languages with typed slots.

The forms are written for this purpose from general knowledge of letters, forms, tickets and lists; they are not taken
from any table. Slots: N a person's name, E a mail address, P a phone number, I an identity number, A a street
address; the rest is ordinary text: T a town, F a firm, G a lake, river or hill, D a date, H a time, Y a year, n a
number, m an amount, R a reference that is no person's number, X a thing. Beside whole sentences, lists of values with
or without labels are put together at random.
"""

from __future__ import annotations

import random
import re

Span = tuple[int, int, str]
KIND = {"N": "name", "E": "email", "P": "phone", "I": "id_number", "A": "address"}
LANGUAGES = ("en", "de", "fr", "es", "nl", "ru")

# Sentences with personal values, one a line.
PERSONAL = {
    "en": r"""My neighbour <N> keeps bees behind <A>.
You can reach our plumber, <N>, on <P> until <H>.
The parcel was left with <N> at <A> because nobody answered.
I spoke to <N> yesterday and got this address: <E>.
If the alarm rings again, phone <P> and ask for <N>.
The court heard that <N>, of <A>, had sold <X> twice.
<N> was born in <T> in <Y> and studied there until <Y>.
According to <N>, <X> had been broken for <n> weeks.
Her passport, number <I>, was found on the train to <T>.
We need a copy of your identity card (<I>) by <D>.
His social security number is <I> and must not be shared.
Tax file <I> belongs to <N>, not to her brother <N>.
From: <N> <E>
Sent by <N> on <D>: thank you for repairing <X>.
Dear <N>, your order <R> has left our store in <T>.
Dear Mrs <N>, we have changed your number to <P>.
Hi <N>, did you get <X> back from <N>?
Best wishes, <N>
Thanks a lot\n<N>\n<P>
The flat at <A> is let to <N> since <Y>.
They moved from <A> to <A> last spring.
Send the bill to <A>, please, not to <F>.
Applications go to <E>, questions to <E>.
Text <P> if you are late; <N> has the keys.
<N> scored twice before <N> equalised for <T>.
The jury chose <N> for her book about <X>.
<N> and <N> founded <F> in <Y>.
Driver <N>, licence holder <I>, was stopped near <T>.
Patient <N>, insurance <I>, was seen on <D> at <H>.
A statement by <N> of <F> was read out in <T>.
"We never closed <X>," <N> told reporters on <D>.
Invoice <R> was paid by <N> through <F>.
The guide's mobile is <P>, her mail <E>.
Contact: <N>, <F>, <A>, <P>, <E>
We asked whether <N> still lived in <T>.
Only <N> knew where <X> was kept.
Please ring <P> about <X>.
No answer from <P>, tried again at <H>.
<N> thanks everyone who wrote.
Minutes were taken by <N>; <N> and <N> sent apologies.""",
    "de": r"""Unser Hausmeister <N> ist bis <H> unter <P> zu sprechen.
Das Paket liegt bei <N> in der <A>, dort hat niemand geklingelt.
Ich habe gestern mit <N> geredet, die Adresse ist <E>.
Bei Störungen bitte <P> wählen und nach <N> fragen.
<N> wurde <Y> in <T> geboren und lernte dort den Beruf.
Laut <N> war <X> seit <n> Wochen kaputt.
Ihr Reisepass mit der Nummer <I> wurde im Zug nach <T> gefunden.
Wir brauchen bis <D> eine Kopie des Ausweises (<I>).
Die Steuernummer <I> gehört <N>, nicht dem Bruder <N>.
Von: <N> <E>
Sehr geehrte Frau <N>, Ihre Bestellung <R> ist unterwegs.
Hallo <N>, hast du <X> zurückbekommen?
Viele Grüße\n<N>
Herzlichst <N>\n<P>
Die Wohnung in der <A> ist seit <Y> an <N> vermietet.
Sie sind von <A> nach <A> umgezogen.
Die Rechnung geht an <A>, nicht an <F>.
Bewerbungen an <E>, Fragen an <E>.
Wer zu spät kommt, ruft <P> an; den Schlüssel hat <N>.
<N> traf zweimal, dann glich <N> für <T> aus.
<N> und <N> gründeten <Y> die Firma <F>.
Patient <N>, Versicherung <I>, kam am <D> um <H>.
„<X> war nie geschlossen“, sagte <N> am <D>.
Ansprechpartner: <N>, <F>, <A>, <P>, <E>
Nur <N> wusste, wo <X> lag.
Unter <P> war niemand zu erreichen.
Protokoll: <N>; entschuldigt fehlten <N> und <N>.
Der Ausweis von <N> trägt die Nummer <I>.
Man fragte, ob <N> noch in <T> wohne.
Die Nachbarin <N> hütet <X>.""",
    "fr": r"""Notre plombier <N> répond au <P> jusqu'à <H>.
Le colis est chez <N>, <A>, personne n'ouvrait.
J'ai parlé hier avec <N>, son adresse est <E>.
En cas de panne, composez le <P> et demandez <N>.
<N> est née à <T> en <Y> et y a étudié.
Selon <N>, <X> ne marchait plus depuis <n> semaines.
Son passeport, numéro <I>, a été retrouvé dans le train de <T>.
Il nous faut une copie de votre carte (<I>) avant le <D>.
Le numéro fiscal <I> est celui de <N>, pas de son frère <N>.
De : <N> <E>
Chère Madame <N>, votre commande <R> est partie.
Bonjour <N>, as-tu récupéré <X> ?
Bien à vous,\n<N>
Amitiés, <N>\n<P>
L'appartement du <A> est loué à <N> depuis <Y>.
Ils ont quitté le <A> pour le <A>.
Envoyez la facture au <A>, pas à <F>.
Les candidatures vont à <E>, les questions à <E>.
Si vous êtes en retard, appelez <P> ; <N> a les clés.
<N> et <N> ont fondé <F> en <Y>.
Patiente <N>, assurée <I>, vue le <D> à <H>.
« <X> n'a jamais fermé », a dit <N> le <D>.
Contact : <N>, <F>, <A>, <P>, <E>
Seul <N> savait où était <X>.
Personne au <P>, nouvel essai à <H>.
Secrétaire de séance : <N> ; excusés : <N> et <N>.
On demandait si <N> vivait encore à <T>.
La voisine <N> garde <X>.""",
    "es": r"""Nuestro fontanero <N> contesta en el <P> hasta las <H>.
El paquete está con <N>, <A>, nadie abría.
Ayer hablé con <N> y me dio esta dirección: <E>.
Si vuelve a fallar, marque <P> y pregunte por <N>.
<N> nació en <T> en <Y> y estudió allí.
Según <N>, <X> llevaba rota <n> semanas.
Su pasaporte, número <I>, apareció en el tren de <T>.
Necesitamos copia de su documento (<I>) antes del <D>.
El número fiscal <I> es de <N>, no de su hermano <N>.
De: <N> <E>
Estimada señora <N>: su compra <R> ya ha salido.
Hola <N>, ¿recuperaste <X>?
Saludos cordiales,\n<N>
Un abrazo, <N>\n<P>
El piso de <A> está alquilado a <N> desde <Y>.
Se mudaron de <A> a <A>.
Mande la factura a <A>, no a <F>.
Las solicitudes van a <E>, las dudas a <E>.
Si llega tarde, llame al <P>; <N> tiene las llaves.
<N> y <N> fundaron <F> en <Y>.
Paciente <N>, seguro <I>, visto el <D> a las <H>.
«<X> nunca cerró», dijo <N> el <D>.
Contacto: <N>, <F>, <A>, <P>, <E>
Solo <N> sabía dónde estaba <X>.
No contestan en el <P>; otro intento a las <H>.
Actas: <N>; se disculparon <N> y <N>.
Preguntaron si <N> seguía en <T>.
La vecina <N> cuida <X>.""",
    "nl": r"""Onze loodgieter <N> is tot <H> te bellen op <P>.
Het pakje ligt bij <N>, <A>, want niemand deed open.
Ik sprak gisteren met <N> en kreeg dit adres: <E>.
Gaat het weer mis, bel dan <P> en vraag naar <N>.
<N> is in <Y> in <T> geboren en leerde daar het vak.
Volgens <N> was <X> al <n> weken stuk.
Haar paspoort met nummer <I> lag in de trein naar <T>.
Wij willen voor <D> een kopie van uw identiteitskaart (<I>).
Het belastingnummer <I> is van <N>, niet van haar broer <N>.
Van: <N> <E>
Geachte mevrouw <N>, uw bestelling <R> is verzonden.
Hoi <N>, heb je <X> terug?
Groeten,\n<N>
Hartelijke groet, <N>\n<P>
De woning aan de <A> wordt sinds <Y> verhuurd aan <N>.
Ze verhuisden van <A> naar <A>.
Stuur de rekening naar <A>, niet naar <F>.
Sollicitaties naar <E>, vragen naar <E>.
Wie te laat is belt <P>; <N> heeft de sleutels.
<N> en <N> richtten <F> op in <Y>.
Patiënt <N>, verzekering <I>, gezien op <D> om <H>.
"<X> is nooit dicht geweest," zei <N> op <D>.
Contact: <N>, <F>, <A>, <P>, <E>
Alleen <N> wist waar <X> lag.
Op <P> nam niemand op.
Notulen: <N>; afwezig waren <N> en <N>.
Men vroeg of <N> nog in <T> woonde.
Buurvrouw <N> past op <X>.""",
    "ru": r"""Наш слесарь <N> отвечает по телефону <P> до <H>.
Посылка у соседа: <N>, <A>.
Вчера я говорил с мастером, его зовут <N>, почта <E>.
Если снова сломается, звоните <P>, спросите: <N>.
<N> родилась в городе <T> в <Y> году.
По словам <N>, <X> не работал <n> недель.
Паспорт <I> нашли в поезде до станции <T>.
Нужна копия документа (<I>) до <D>.
ИНН <I> принадлежит <N>, а не <N>.
От: <N> <E>
Уважаемая <N>, ваш заказ <R> отправлен.
Привет, <N>, ты забрал <X>?
С наилучшими пожеланиями,\n<N>
Спасибо! <N>\n<P>
Квартиру по адресу <A> с <Y> года снимает <N>.
Они переехали: раньше <A>, теперь <A>.
Счёт направьте на <A>, а не в <F>.
Заявки на <E>, вопросы на <E>.
Опаздываете — звоните <P>, ключи у <N>.
<N> и <N> основали <F> в <Y> году.
Пациент <N>, полис <I>, приём <D> в <H>.
«<X> никогда не закрывали», — сказал <N> <D>.
Контакты: <N>, <F>, <A>, <P>, <E>
Только <N> знал, где <X>.
По номеру <P> не ответили.
Секретарь собрания: <N>; отсутствовали <N> и <N>.
Спросили, живёт ли <N> ещё в <T>.
Соседка <N> хранит <X>.""",
}

# What may stand before and after a name, and before other values, to be put together at random.
BEFORE = {
    "en": "yesterday|we met|he wrote to|she called|they asked|then|later|in <T>,|on <D>|the old teacher|a friend of|thanks to|after that|before lunch|with|without|for|from|and|but|because|when|where|my uncle|the mayor,|her cousin|this photo shows|please help|nobody saw|the letter from|a song by|the house of|I think that|last week|under the roof,|according to the list,|as usual,|in the end|at noon|during the storm|near <G>|of course|the nurse told|not even|only|perhaps|since <Y>",
    "de": "gestern|wir trafen|er schrieb an|sie rief|dann|später|in <T>|am <D>|der alte Lehrer|ein Freund von|dank|danach|vor dem Essen|mit|ohne|für|von|und|aber|weil|als|wo|mein Onkel|die Bürgermeisterin|ihr Vetter|dieses Bild zeigt|niemand sah|der Brief von|ein Lied von|das Haus von|ich glaube, dass|letzte Woche|laut Liste|wie immer|am Ende|mittags|im Sturm|bei <G>|natürlich|nicht einmal|nur|vielleicht|seit <Y>|nach dem Regen hat|trotz der Kälte|im Winter|deshalb",
    "fr": "hier|nous avons rencontré|il écrit à|elle appelait|alors|plus tard|à <T>,|le <D>|le vieux maître|un ami de|grâce à|ensuite|avant midi|avec|sans|pour|de|et|mais|parce que|quand|mon oncle|la mairesse|sa cousine|cette photo montre|personne n'a vu|la lettre de|une chanson de|la maison de|je crois que|la semaine dernière,|selon la liste,|comme toujours,|à la fin|pendant l'orage,|près de <G>|même|seulement|peut-être|depuis <Y>|avec la pluie,|cet hiver,|on dit que",
    "es": "ayer|encontramos a|escribió a|llamó a|luego|más tarde|en <T>,|el <D>|el viejo maestro|un amigo de|gracias a|después|antes de comer|con|sin|para|de|y|pero|porque|cuando|mi tío|la alcaldesa|su prima|esta foto muestra a|nadie vio a|la carta de|una canción de|la casa de|creo que|la semana pasada,|según la lista,|como siempre,|al final|durante la tormenta,|cerca de <G>|ni siquiera|solo|quizá|desde <Y>|con la lluvia,|este invierno,|dicen que",
    "nl": "gisteren|we zagen|hij schreef aan|zij belde|toen|later|in <T>|op <D>|de oude meester|een vriend van|dankzij|daarna|voor het eten|met|zonder|voor|van|en|maar|omdat|als|waar|mijn oom|de burgemeester|haar nicht|deze foto toont|niemand zag|de brief van|een lied van|het huis van|ik denk dat|vorige week|volgens de lijst|zoals altijd|aan het eind|tijdens de storm|bij <G>|zelfs|alleen|misschien|sinds <Y>|door de regen|deze winter|daarom",
    "ru": "вчера|мы встретили|он написал|она позвонила|потом|позже|в городе <T>|<D>|старый учитель|друг по имени|спасибо,|затем|до обеда|и|но|потому что|когда|мой дядя|мэр|её сестра|на снимке|никто не видел, как|письмо пишет|песню пел|дом строил|думаю, что|на прошлой неделе|по списку|как всегда,|в конце|во время бури|у <G>|даже|только|может быть,|с <Y> года|из-за дождя|этой зимой|говорят, что|ждёт",
}
AFTER = {
    "en": "sings|came late|and his wife|won a prize|has sold the shop|from <T>|the carpenter|with <n> votes|in <Y>|was tired|is our guest|will open <X>|who repairs <X>|, aged <n>,|again|for <n> years|wrote about <X>|to the doctor|on the stairs|laughed|did not come|at <F>|near <G>|has a boat|and <X>|out of the hall|back to <T>|by hand|had built <X>|told a story|about the war",
    "de": "singt|kam zu spät|und seine Frau|gewann einen Preis|hat den Betrieb verkauft|aus <T>|der Tischler|mit <n> Stimmen|im Jahr <Y>|war müde|ist unser Gast|öffnet das Tor|, der <X> repariert,|, <n> Jahre alt,|wieder|seit <n> Jahren|den ganzen Tag|zum Arzt|auf der Treppe|lachte|kam nicht|bei <F>|am Ufer|ein Boot|und <X>|aus dem Saal|nach <T> zurück|die Bäume gefällt|das Dach gedeckt|den Kuchen|vom Krieg erzählt",
    "fr": "chante|est arrivé tard|et sa femme|a gagné un prix|a vendu l'atelier|de <T>|le menuisier|avec <n> voix|en <Y>|était fatigué|est notre invité|ouvrira la porte|qui répare <X>|, <n> ans,|encore|depuis <n> ans|a écrit sur <X>|chez le médecin|dans l'escalier|riait|n'est pas venu|chez <F>|sur la rive|a un bateau|et <X>|sortait de la salle|à <T>|la nuit|avait construit <X>|aux enfants",
    "es": "canta|llegó tarde|y su mujer|ganó un premio|vendió el taller|de <T>|el carpintero|con <n> votos|en <Y>|estaba cansado|es nuestro invitado|abrirá la puerta|, que repara <X>,|, de <n> años,|otra vez|desde hace <n> años|escribió sobre <X>|al médico|en la escalera|se reía|no vino|en <F>|en la orilla|tiene un barco|y <X>|salía de la sala|a <T>|de noche|había construido <X>|a los niños",
    "nl": "zingt|kwam te laat|en zijn vrouw|won een prijs|heeft de zaak verkocht|uit <T>|de timmerman|met <n> stemmen|in <Y>|was moe|is onze gast|opent de deur|, die <X> maakt,|, <n> jaar,|weer|al <n> jaar|schreef over <X>|naar de dokter|op de trap|lachte|kwam niet|bij <F>|aan de oever|heeft een boot|en <X>|de zaal uit|naar <T>|in de nacht|de bomen om|het dak op",
    "ru": "поёт|пришёл поздно|и его жена|получила премию|продал мастерскую|из <T>|плотник|, <n> голосов,|в <Y> году|устала|наш гость|откроет дверь|, который чинит <X>,|, <n> лет,|снова|уже <n> лет|писал про <X>|к врачу|на лестнице|смеялась|не пришёл|в <F>|на берегу|купил лодку|и <X>|выходит из зала|ночью|построил <X>|детям",
}
# Requests at the head of a sentence, frequent verbs of a third person, and questions without personal values.
REQUESTS = {
    "en": "ask|tell|phone|ring|call|thank|visit|remind|invite|help|warn|pay|follow|greet|find|meet|trust|forgive|see|let|send|show|give|bring|keep|bless|join|introduce|answer|write to|speak to|wait for|listen to|hello|goodbye|congratulations to",
    "de": "fragen Sie|rufen Sie|treffen Sie|grüßen Sie|besuchen Sie|bezahlen Sie|suchen Sie|bitten Sie|melden Sie|frag|ruf|grüß|hilf|danke an|Gruß an|Rückruf bei|Besuch von|Nachricht von|Termin mit|Vortrag von|Brief an|Glückwunsch an|Antwort von",
    "fr": "demandez à|téléphonez à|appelez|voyez|remerciez|aidez|payez|invitez|prévenez|suivez|cherchez|saluez|parlez à|attendez|merci à|rappel de|visite de|message de|réunion avec|lettre à|bravo à|réponse de",
    "es": "pregunte a|llame a|visite a|avise a|ayude a|pague a|salude a|busque a|invite a|espere a|hable con|recuerde a|gracias a|visita de|mensaje de|reunión con|carta a|enhorabuena a|respuesta de|siga a",
    "nl": "vraag|bel|bezoek|bedank|help|betaal|groet|zoek|volg|waarschuw|spreek met|wacht op|herinner|dank aan|bezoek van|bericht van|afspraak met|brief aan|groeten aan|antwoord van|telefoon voor",
    "ru": "спросите|позвоните|найдите|поблагодарите|пригласите|предупредите|встретьте|поздравьте|помогите|передайте|напишите|звонок от|ответ от|письмо для|встреча:|спасибо,|привет,",
}
VERBS = {
    "en": "said|says|asked|answered|went|came|took|made|gave|got|found|lost|left|stayed|lives|lived|works|worked|knew|thought|wanted|needed|bought|sold|paid|sent|wrote|read|signed|opened|closed|started|stopped|tried|helped|called|met|saw|heard|told|showed|kept|brought|carried|played|ran|won|died|learned|teaches|moved|painted|cleaned|cut|drove|waited|agreed|refused|did not want|does not know|has seen|had taken|will take|can use|must pay",
    "de": "sagte|sagt|fragte|antwortete|ging|kam|nahm|machte|gab|bekam|fand|verlor|verließ|blieb|wohnt|lebte|arbeitet|wusste|dachte|wollte|brauchte|kaufte|verkaufte|zahlte|schickte|schrieb|las|unterschrieb|öffnete|schloss|begann|versuchte|half|rief|traf|sah|hörte|zeigte|behielt|brachte|trug|spielte|starb|lernte|zog|malte|fuhr|wartete|bat um|verlangte|kennt|hat|muss|kann|wird|soll|darf",
    "fr": "dit|demanda|a demandé|répondit|alla|est venu|prit|fit|a donné|reçut|trouva|a perdu|quitta|resta|habite|vivait|travaille|savait|pensait|voulait|acheta|a vendu|paya|envoya|écrivit|lut|a signé|ouvrit|ferma|commença|essaya|aida|appela|rencontra|a vu|entendit|montra|garda|apporta|jouait|mourut|apprit|peint|attendait|refuse|connaît|doit|peut|veut|a pris|avait",
    "es": "dijo|preguntó|pidió|respondió|fue|vino|tomó|hizo|dio|recibió|encontró|perdió|dejó|quedó|vive|vivía|trabaja|sabía|pensaba|quería|compró|vendió|pagó|envió|escribió|leyó|firmó|abrió|cerró|empezó|intentó|ayudó|llamó|conoció|vio|oyó|mostró|guardó|trajo|jugaba|murió|aprendió|pintó|esperaba|rechazó|conoce|debe|puede|ha tomado|había visto",
    "nl": "zei|vroeg|antwoordde|ging|kwam|nam|maakte|gaf|kreeg|vond|verloor|verliet|bleef|woont|leefde|werkt|wist|dacht|wilde|kocht|verkocht|betaalde|stuurde|schreef|las|tekende|opende|sloot|begon|probeerde|hielp|belde|ontmoette|zag|hoorde|toonde|hield|bracht|droeg|speelde|stierf|leerde|schilderde|wachtte|weigerde|kent|moet|kan|wil|heeft|had",
    "ru": "сказал|спросила|попросил|ответила|пошёл|пришла|взял|сделала|дал|получила|нашёл|потеряла|ушёл|осталась|живёт|жила|работает|знал|думала|хотел|купила|продал|заплатила|отправил|читала|подписал|открыла|закрыл|начала|помог|звонила|встретил|видела|слышал|показала|принёс|играла|умер|училась|рисовал|ждала|отказался|знает|должен|может|хочет",
}
QUESTIONS = {
    "en": "can one visit <T> in winter?|is there a bus to <T>?|does <F> still make <X>?|how far is it to <T>?|who will mend <X>, and when?|why did <T> lose?|must <X> be so dear?|which is older, <T> or <T>?",
    "de": "kann man <T> im Winter besuchen?|gibt es einen Bus nach <T>?|stellt <F> noch <X> her?|wie weit ist es bis <T>?|warum hat <T> verloren?|wer repariert <X>, und wann?|falls <T> gewinnt, feiern wir.|ob <T> größer ist, weiß ich nicht.",
    "fr": "peut-on visiter <T> en hiver ?|y a-t-il un car pour <T> ?|est-ce que <F> fabrique encore <X> ?|à quelle distance est <T> ?|pourquoi <T> a-t-il perdu ?|doit-on payer <X> ?|combien coûte <X> ?|qu'est-ce que <X> ?|vaut-il mieux passer par <T> ?|a-t-on trouvé <X> ?|sait-on si <T> viendra ?",
    "es": "¿se puede visitar <T> en invierno?|¿hay autobús a <T>?|¿fabrica <F> todavía <X>?|¿a qué distancia está <T>?|¿por qué perdió <T>?|¿cuánto cuesta <X>?|¿quién arregla <X>?",
    "nl": "kun je <T> in de winter bezoeken?|gaat er een bus naar <T>?|maakt <F> nog <X>?|hoe ver is het naar <T>?|waarom verloor <T>?|wie maakt <X>, en wanneer?|als <T> wint, vieren we feest.",
    "ru": "можно ли зимой посетить <T>?|есть ли автобус в <T>?|делает ли <F> ещё <X>?|далеко ли до <T>?|почему <T> проиграл?|сколько стоит <X>?|кто починит <X>?",
}
OBJECTS = {
    "en": "<X>|<X> from <T>|in <T>|<n> times|a lot|it|nothing|at <H>|on <D>|with <X>|for <X>|at home|to <T>|that <X> was gone", "de": "<X>|<X> aus <T>|in <T>|<n> Mal|viel|es|nichts|um <H>|am <D>|mit <X>|für <X>|zu Hause|nach <T>", "fr": "<X>|<X> de <T>|à <T>|<n> fois|beaucoup|tout|rien|à <H>|le <D>|avec <X>|pour <X>|chez soi|que <X> manquait",
    "es": "<X>|<X> de <T>|en <T>|<n> veces|mucho|todo|nada|a las <H>|el <D>|con <X>|para <X>|en casa|que faltaba <X>", "nl": "<X>|<X> uit <T>|in <T>|<n> keer|veel|alles|niets|om <H>|op <D>|met <X>|voor <X>|thuis|dat <X> weg was", "ru": "<X>|<X> из <T>|в <T>|<n> раз|много|всё|ничего|в <H>|<D>|с утра|для дома|дома|про <X>",
}
ORDINARY_AFTER = {
    "en": "<n> visitors came|<n> of them left|the river rose|<X> broke|nobody came|<T> was quiet|<n> people waited|it was <n> degrees", "de": "<n> Gäste kamen|<n> davon gingen|der Fluss stieg|<X> zerbrach|niemand kam|<T> war still|<n> Leute warteten|der Ofen ging aus", "fr": "<n> visiteurs vinrent|<n> restèrent|la rivière montait|<X> cassa|personne ne vint|<T> dormait|<n> personnes attendaient|le four s'éteignit",
    "es": "<n> vinieron tarde|<n> de ellos faltan|el río subía|<X> se rompió|nadie vino|<T> dormía|<n> personas esperaban|se apagó el horno", "nl": "<n> gasten kwamen|<n> bleven weg|de rivier steeg|<X> brak|niemand kwam|<T> sliep|<n> mensen wachtten|de oven ging uit", "ru": "<n> гостей пришли|<n> ушли|река поднялась|<X> сломался|никто не пришёл|<T> спал|<n> человек ждали|печь погасла",
}
TOWARDS = {
    "E": {"en": "to|at|via|under|mail|is|was|write|from|use|sent from|or|not", "de": "an|unter|über|per Mail an|lautet|ist|schreiben Sie|von|oder|nicht", "fr": "à|sur|via|est|était|écrivez à|de|ou|pas", "es": "a|en|por|es|era|escriba a|de|o|no", "nl": "aan|op|via|is|was|schrijf|van|of|niet", "ru": "на|через|это|была|пишите|от|или|не"},
    "P": {"en": "at|on|under|is|dial|ring|via|was|or|the old number|text|call back", "de": "unter|auf|ist|wählen Sie|über|war|oder|die alte Nummer|zurückrufen:|Telefon", "fr": "au|sur|est|composez|via|était|ou|l'ancien numéro|rappeler le|faites le", "es": "al|en el|es|marque el|por el|era|o|el número antiguo|devolver llamada:|llamar al", "nl": "op|via|is|draai|was|of|het oude nummer|terugbellen:|bel", "ru": "по|на|это|наберите|был|или|старый номер|перезвонить:|номер"},
    "I": {"en": "card|number|holder of|passport|under|is|identity|licence|visa|document|insured as|registered as|papers", "de": "Ausweis|Nummer|Inhaber von|Pass|unter|ist|Visum|Dokument|versichert als|Papiere|Führerschein", "fr": "carte|numéro|titulaire de|passeport|sous|est|visa|document|assuré|papiers|permis", "es": "carné|número|titular de|pasaporte|con|es|visado|documento|asegurado|papeles|permiso", "nl": "kaart|nummer|houder van|pas|onder|is|visum|document|verzekerd als|papieren|rijbewijs", "ru": "карта|номер|владелец|паспорт|под номером|виза|документ|полис|бумаги|права|удостоверение"},
    "A": {"en": "at|to|from|near|behind|in front of|lives at|is|or|between|the shop at|of", "de": "in der|an der|nach|aus der|neben|hinter|wohnt|ist|oder|der Laden in der|an|bei", "fr": "au|à|du|près du|derrière le|habite|est|ou|la boutique du|chez, ", "es": "en|a|de|cerca de|detrás de|vive en|es|o|la tienda de|junto a", "nl": "op|aan de|naar|van|achter|woont|is|of|de winkel aan de|bij", "ru": "по адресу|на|у дома|рядом:|за домом|живёт:|это|или|лавка:|адрес"},
}

# Sentences without personal values.
ORDINARY = {
    "en": """The museum in <T> opens at <H> and closes at <H>.
<F> reported sales of <m> for <Y>.
Chapter <n> describes <X> in detail.
It took <n> men <n> days to lift <X>.
Boil <n> g of rice in <n> ml of water for <n> minutes.
The train from <T> to <T> was <n> minutes late on <D>.
Version <v> fixes <n> bugs in <X>.
Invoice <R> of <D> over <m> is still open.
Parcel <R> is waiting in <T>.
Part no. <R> fits <X> made after <Y>.
Your ticket <R> was closed at <H>.
Serial number <R>, made in <T>.
They walked around <G> and came home at <H>.
<G> froze over in <Y>.
In <T>, nobody knew <X>.
<T> beat <T> <n>-<n> on <D>.
Who painted <X>?
<F> and <F> will merge in <Y>.
The temperature fell to -<n>.<n> degrees near <G>.
See page <n>, table <n>, line <n>.
Flight <R> left at <H> from gate <n>.
ISBN <isbn>, <n> pages, <m>.
Room <n>, second floor, turn left at <X>.
Shares of <F> rose <n>.<n> % to <m>.
Do not store <X> above <n> °C.
The bridge over <G> is <n> m long and was built in <Y>.
Between <Y> and <Y> the town of <T> lost <n> mills.
At first, <X> looked lost.
Some of <X> came from <T>, some from <T>.
Only then did <T> answer.
The tag #<w><n> was used <n>,<n3> times.
Follow @<w><n> for news about <X>.
Open <w>.<w>, change <w>_<w> to <n> and save.
On Monday and Friday the market in <T> sells <X>.
Meter reading: <R>.
Counter <R>, lot <R>.
The March issue has <n> pages about <X>.
If it rains in <T>, bring <X> inside.
We measured <n> x <n> x <n> cm.
Half of <X> was gone by <H>.
Icon <file> is missing from <file>.
Read pages <n>-<n> and <n>/<n>.
A road leads from <T> to <T> through <T>.
The <n>th race starts on the <n>th of May.
Key <hex> was replaced by 0x<hex>.""",
    "de": """Das Museum in <T> öffnet um <H> und schließt um <H>.
<F> meldete für <Y> einen Umsatz von <m>.
Kapitel <n> beschreibt <X> genau.
<n> Arbeiter brauchten <n> Tage für <X>.
Den Reis (<n> g) in <n> ml Wasser <n> Minuten kochen.
Der Zug von <T> nach <T> kam am <D> <n> Minuten zu spät.
Version <v> behebt <n> Fehler.
Die Rechnung <R> vom <D> über <m> ist offen.
Sendung <R> liegt in <T> bereit.
Artikel <R> passt zu Modellen ab Baujahr <Y>.
Seriennummer <R>, hergestellt in <T>.
Wir gingen um <G> herum.
Im Jahr <Y> fror <G> zu.
In <T> kannte niemand <X>.
<T> schlug <T> am <D> mit <n>:<n>.
<F> und <F> schließen sich <Y> zusammen.
Siehe Seite <n>, Tabelle <n>, Zeile <n>.
Zimmer <n>, zweiter Stock, links neben der Treppe.
Die Aktie von <F> stieg um <n>,<n> % auf <m>.
Die Brücke ist <n> m lang und stammt aus <Y>.
Erst danach antwortete <T>.
Zwischen Küche und Bad fehlt eine Tür.
Die Kleine Halle und der Große Saal sind belegt.
Am Montag und Freitag ist Markt in <T>.
Zählerstand <R>, Los <R>.
Gesucht werden Lehrer, Köche und Fahrer ab <D>.
Regnet es in <T>, kommt <X> ins Haus.
Gegen Mittag fiel in der Werkstatt der Strom aus.
Bei Frost bleibt das Tor im Hof geschlossen.
Um <H> war die Hälfte verkauft.
Das Bild <file> fehlt in <file>.
Bitte Seite <n>-<n> und <n>/<n> lesen.
Von <T> über <T> nach <T> fährt ein Bus.
Schlüssel <hex> ersetzt 0x<hex>; am <n>. Mai geht es weiter.""",
    "fr": """Le musée de <T> ouvre à <H> et ferme à <H>.
<F> annonce un chiffre de <m> pour <Y>.
Le chapitre <n> décrit <X> en détail.
Il a fallu <n> jours pour réparer <X>.
Cuire <n> g de riz dans <n> ml d'eau pendant <n> minutes.
Le train de <T> à <T> avait <n> minutes de retard le <D>.
La version <v> corrige <n> erreurs.
La facture <R> du <D>, d'un montant de <m>, reste ouverte.
Le colis <R> attend à <T>.
La pièce <R> convient aux modèles de <Y>.
Numéro de série <R>, fabriqué à <T>.
Nous avons fait le tour de <G>.
En <Y>, <G> a gelé.
À <T>, personne ne connaissait <X>.
<T> a battu <T> <n>-<n> le <D>.
<F> et <F> fusionnent en <Y>.
Voir page <n>, tableau <n>, ligne <n>.
Chambre <n>, deuxième étage, à gauche.
L'action de <F> gagne <n>,<n> % à <m>.
Le pont mesure <n> m et date de <Y>.
Alors seulement <T> répondit.
Lundi et vendredi, le marché de <T> vend <X>.
Relevé du compteur : <R>, lot <R>.
S'il pleut à <T>, rentrez <X>.
La moitié était partie à <H>.
L'image <file> manque dans <file>.
Lire les pages <n>-<n> et <n>/<n>.
Un bus va de <T> à <T> par <T>.
C'est la <n>e fois au <n>e étage.
La clé <hex> remplace 0x<hex>.""",
    "es": """El museo de <T> abre a las <H> y cierra a las <H>.
<F> anunció ventas de <m> en <Y>.
El capítulo <n> describe <X> con detalle.
Hicieron falta <n> días para arreglar <X>.
Cueza <n> g de arroz en <n> ml de agua <n> minutos.
El tren de <T> a <T> llegó <n> minutos tarde el <D>.
La versión <v> corrige <n> errores.
La factura <R> del <D> por <m> sigue abierta.
El envío <R> espera en <T>.
La pieza <R> sirve para modelos de <Y>.
Número de serie <R>, hecho en <T>.
Dimos la vuelta a <G>.
En <Y> se heló <G>.
En <T> nadie conocía <X>.
<T> ganó a <T> por <n>-<n> el <D>.
<F> y <F> se unen en <Y>.
Véase la página <n>, tabla <n>, línea <n>.
Habitación <n>, segunda planta, a la izquierda.
La acción de <F> sube un <n>,<n> % hasta <m>.
El puente mide <n> m y es de <Y>.
Solo entonces respondió <T>.
Lunes y viernes, el mercado de <T> vende <X>.
Lectura del contador: <R>, lote <R>.
Si llueve en <T>, meta <X> en casa.
A las <H> faltaba la mitad.
Falta la imagen <file> en <file>.
Lea las páginas <n>-<n> y <n>/<n>.
Un autobús va de <T> a <T> por <T>.
La clave <hex> sustituye a 0x<hex> en el piso <n>.º.""",
    "nl": """Het museum in <T> gaat open om <H> en dicht om <H>.
<F> meldde over <Y> een omzet van <m>.
Hoofdstuk <n> beschrijft <X> precies.
Het kostte <n> dagen om <X> te maken.
Kook <n> g rijst in <n> ml water, <n> minuten.
De trein van <T> naar <T> was op <D> <n> minuten te laat.
Versie <v> verhelpt <n> fouten.
Factuur <R> van <D> over <m> staat nog open.
Zending <R> ligt klaar in <T>.
Onderdeel <R> past op modellen vanaf <Y>.
Serienummer <R>, gemaakt in <T>.
We liepen om <G> heen.
In <Y> vroor <G> dicht.
In <T> kende niemand <X>.
<T> won op <D> met <n>-<n> van <T>.
<F> en <F> gaan in <Y> samen.
Zie bladzijde <n>, tabel <n>, regel <n>.
Kamer <n>, tweede verdieping, links.
Het aandeel <F> steeg <n>,<n> % tot <m>.
De brug is <n> m lang en komt uit <Y>.
Pas toen antwoordde <T>.
Op maandag en vrijdag verkoopt de markt in <T> <X>.
Meterstand <R>, partij <R>.
Als het in <T> giet, haal dan <X> binnen.
Om <H> was de helft weg.
Plaatje <file> ontbreekt in <file>.
Lees bladzijde <n>-<n> en <n>/<n>.
Een bus rijdt van <T> via <T> naar <T>.
Voor de <n>e keer op de <n>e mei.
Sleutel <hex> vervangt 0x<hex>.""",
    "ru": """Музей в городе <T> открыт с <H> до <H>.
<F> сообщила о продажах на <m> за <Y> год.
В главе <n> описан <X>.
На ремонт ушло <n> дней.
Варите <n> г риса в <n> мл воды <n> минут.
Поезд <T> — <T> опоздал на <n> минут <D>.
В версии <v> исправлено <n> ошибок.
Счёт <R> от <D> на сумму <m> не оплачен.
Посылка <R> ждёт в отделении <T>.
Деталь <R> подходит к моделям с <Y> года.
Серийный номер <R>, сделано в <T>.
Мы обошли <G>.
В <Y> году замёрзло <G>.
В <T> никто не знал про <X>.
<T> выиграл у <T> <n>:<n> <D>.
<F> и <F> объединятся в <Y> году.
Смотрите страницу <n>, таблицу <n>, строку <n>.
Комната <n>, второй этаж, налево.
Акции <F> выросли на <n>,<n> % до <m>.
Мост длиной <n> м построен в <Y> году.
Только тогда <T> ответил.
В понедельник и пятницу на рынке в <T> продают <X>.
Показание счётчика <R>, партия <R>.
Если в <T> пойдёт снег, занесите <X>.
К <H> половины уже не было.
Картинки <file> нет в <file>.
Читайте страницы <n>-<n> и <n>/<n>.
Автобус идёт из <T> в <T> через <T>.
Ключ <hex> вместо 0x<hex>, это <n>-й раз.""",
}

# What else stands in crawled texts.
NOISE = r"""<a href="/<w>/<n>"><w> <w></a>
def <w>(<w>, n=<n>):\n    return <w>[n] + <n>
SELECT <w> FROM <w> WHERE <w> > <n>
<w>=<n>&<w>=<n>
<n>;<n>;<n>
| <w> | <n> | <n> |
[<n>] https://<w>.test/<w>/<w>?page=<n>
* <X>
&bull; <w> &nbsp; <w>
<<foreign>>
<foreign> <foreign>
<foreign> <n> <foreign>
ⓘ ✓ ★★★☆☆ <n>
<rule>
0x<hex> <hex>
<T> | <T> | <T>
🙂🙂 <w>!!
½ ⅓ x² ≤ <n>
/usr/<w>/<w>.<w>
<w>@2x.png, <w>@3x.jpg, <w><n>@2x.<w>
npm install <w>@<v>
<w>@<w>:~$ ls
<X>: <n>
<X>: <n> kg, <n> cm
<n> <w>, <n> <w>
<w> <w> <w>, <w> <n> <w>.
© <Y> <F>"""

LABELS = {
    "en": {"N": "Name|Client|Tenant|Signed|Attn|Applicant|Guest|name|Caller|Owner of record", "E": "Mail|E-mail|email|Write to|Reply-To|Inbox", "P": "Phone|Tel|Tel.|Mobile|Cell|Fax|phone|Call|Hotline|Ph.", "I": "ID|Passport|Passport no.|SSN|NI number|Tax ID|Insurance no.|id|National ID|Identity number|ID card", "A": "Address|Home|Residence|Deliver to|Street|addr|Lives at|Site", "R": "Order|Invoice|Batch|Serial|Ticket|Tracking|Part|Ref.|Lot|Article|Counter|order no.|Flight|Booking|Meter|Reading|Item|Model|Code|File|Receipt|Account|counter|lot|part"},
    "de": {"N": "Name|Kunde|Mieterin|Gezeichnet|z. Hd.|Anrufer|Inhaberin", "E": "Mail|E-Mail|Post an|Antwort an", "P": "Telefon|Tel.|Mobil|Fax|Handy|Rufnummer", "I": "Ausweis|Reisepass|Pass-Nr.|Steuer-ID|Versichertennummer|Personalausweis|Sozialversicherung|ID", "A": "Anschrift|Adresse|Wohnort|Lieferung an|Wohnhaft", "R": "Bestellung|Rechnung|Charge|Serie|Vorgang|Sendung|Teil|Zähler|Artikel|Auftragsnr.|Buchung|Zählerstand|Modell|Auftrag|Beleg|Konto|Aktenzeichen|Code|Gerät"},
    "fr": {"N": "Nom|Client|Locataire|Signé|À l'attention de|Titulaire", "E": "Courriel|Mail|E-mail|Écrire à", "P": "Téléphone|Tél.|Portable|Fax|Mobile", "I": "Passeport|Carte d'identité|N° fiscal|Sécurité sociale|NIR|Pièce d'identité|ID", "A": "Adresse|Domicile|Livrer à|Résidence", "R": "Commande|Facture|Lot|Série|Dossier|Colis|Pièce|Compteur|Article|Réf.|Réservation|Modèle|Bon|Compte|Relevé|Code|Appareil|N° de lot"},
    "es": {"N": "Nombre|Cliente|Inquilina|Firmado|A la atención de|Titular", "E": "Correo|Email|E-mail|Escribir a", "P": "Teléfono|Tel.|Móvil|Fax|Tfno.", "I": "DNI|NIE|Pasaporte|NIF|Seguridad Social|Documento|Cédula|ID", "A": "Dirección|Domicilio|Entregar en|Residencia", "R": "Pedido|Factura|Lote|Serie|Expediente|Envío|Pieza|Contador|Artículo|Ref.|Reserva|Modelo|Recibo|Cuenta|Código|Lectura|Aparato|N.º de lote"},
    "nl": {"N": "Naam|Klant|Huurder|Getekend|T.a.v.|Houder", "E": "Mail|E-mail|Schrijf naar|Antwoord aan", "P": "Telefoon|Tel.|Mobiel|Fax|Tel", "I": "Paspoort|BSN|Identiteitskaart|Fiscaal nummer|Verzekeringsnr.|Rijbewijs|ID", "A": "Adres|Woonadres|Bezorgen op|Thuis", "R": "Bestelling|Factuur|Partij|Serie|Zaak|Zending|Onderdeel|Meter|Artikel|Ref.|Boeking|Teller|Model|Bon|Opdracht|Code|Rekening|Toestel"},
    "ru": {"N": "Имя|Ф. И. О.|ФИО|Клиент|Подпись|Кому|Владелец", "E": "Почта|Эл. почта|E-mail|Писать на", "P": "Телефон|Тел.|Моб.|Факс|тел", "I": "Паспорт|СНИЛС|ИНН|Удостоверение|Полис|Документ|Паспорт №", "A": "Адрес|Проживает|Доставить|Прописка", "R": "Заказ|Счёт|Партия|Серия|Заявка|Посылка|Деталь|Счётчик|Артикул|Накладная|Модель|Код|Чек|Договор|Счётчик №|Прибор"},
}
TITLES = {"en": "Mr|Mrs|Ms|Dr|Dr.|Prof.|Sir|Miss|Mr.", "de": "Herr|Frau|Dr.|Prof.|Herrn", "fr": "M.|Mme|Dr|Pr|Monsieur|Madame", "es": "Sr.|Sra.|Dr.|Dra.|don|doña", "nl": "dhr.|mevr.|dr.|mevrouw|meneer", "ru": "г-н|г-жа|д-р|проф.|господин"}
NOUNS = {
    "en": "window|hammer|boat|letter|orchard|roof tile|clock|carpet|bicycle|radio|sack of flour|violin|map|chimney|tractor|camera|blanket|tea set|contract|notice board|beehive|garden wall|engine|mirror|choir book|lift|saddle|printer|freezer|cheese",
    "de": "Fenster|Hammer|Boot|Brief|Garten|Dachziegel|Uhr|Teppich|Fahrrad|Radio|Mehlsack|Geige|Karte|Schornstein|Traktor|Kamera|Decke|Vertrag|Aushang|Bienenstock|Mauer|Motor|Spiegel|Aufzug|Sattel|Drucker|Gefrierfach|Käse",
    "fr": "fenêtre|marteau|bateau|lettre|verger|tuile|horloge|tapis|vélo|radio|sac de farine|violon|carte|cheminée|tracteur|couverture|contrat|affiche|ruche|mur du jardin|moteur|miroir|ascenseur|selle|imprimante|fromage",
    "es": "ventana|martillo|barco|carta|huerto|teja|reloj|alfombra|bicicleta|radio|saco de harina|violín|mapa|chimenea|tractor|manta|contrato|cartel|colmena|muro|motor|espejo|ascensor|silla|impresora|queso",
    "nl": "raam|hamer|boot|brief|boomgaard|dakpan|klok|tapijt|fiets|radio|zak meel|viool|kaart|schoorsteen|trekker|deken|contract|prikbord|bijenkorf|tuinmuur|motor|spiegel|lift|zadel|printer|kaas",
    "ru": "окно|молоток|лодка|письмо|сад|черепица|часы|ковёр|велосипед|радио|мешок муки|скрипка|карта|труба|трактор|одеяло|договор|объявление|улей|забор|мотор|зеркало|лифт|седло|принтер|сыр",
}
DETERMINERS = {
    "en": "the|the|a|this|that|my|your|his|her|its|their|some|each|no|the old|the new|the red|every|our|the small|another|two|three|many|both", "de": "das|der|die|den|dem|ein|eine|einen|dieses|jeder|mein|ihr|der neue|die alte|unser|kein|das rote|der kleine|die letzte|zwei|drei|viele|alle|beide|einige",
    "fr": "le|la|les|un|une|des|du|ce|cette|mon|leur|notre|le vieux|la nouvelle|le petit|chaque|deux|trois|plusieurs|quelques", "es": "el|la|los|las|un|una|este|esta|su|mi|nuestra|el viejo|la nueva|cada|el pequeño|dos|tres|varios|muchos", "nl": "het|de|een|dit|die|deze|zijn|geen|onze|de oude|het nieuwe|elke|de kleine|twee|drie|veel|alle", "ru": "старый|новый|наш|этот|красный|чужой|каждый|мой|их|другой|маленький|два|три|много|все",
}
OF_NOUN = {"en": ["{a} {b}", "{a} of the {b}"], "de": ["{a}{c}", "{a} im {b}", "{a} der {b}"], "fr": ["{a} du {b}", "{a} de la {b}", "{a} à {b}", "{a} des {b}", "{a} d'{b}"], "es": ["{a} del {b}", "{a} de la {b}", "{a} de {b}", "{a} de los {b}"], "nl": ["{a} van de {b}", "{a}{c}", "{a} voor het {b}"], "ru": ["{a} и {b}", "{a} для {b}"]}
FIRMS = "Ltd|GmbH|Inc.|SA|BV|AG|Group|Industries|Holdings|Partners|Trading|Motors|Systems|Foods|Textiles|Bakery|Brewery|Shipping|Logistics|Steel|Chemicals|Publishing|Institute|University|Bank|Clinic|School|Airlines|Insurance|Media|Software|Solutions|Consulting|Technologies|Services|International|Associates|Capital|Ventures|Records|Films|Pharma|Optics|Instruments|Machinery|Plastics|Glass|Timber|Furniture|Toys|Games|Travel|Tours|Cars|Rail|Airways|Marine|Oil|Water|Power|Cement|Bricks|Metals|Wire|Cables|Valves|Pumps|Gears|Batteries|Networks|Radio|News|Times|Books|Printing|Packaging|Fashion|Shoes|Cosmetics|Coffee|Wines|Fisheries|Seeds|Flowers|Foundation|Trust|Union|Federation|Academy|College|Library|Archive|Orchestra|Choir|United|City|Rovers|Party|Castle|Park|Airport|Station|Cathedral|& Sons|& Co.|Brothers|Energy|Tools|Paper|Museum|Hotel|Club|Works|Mills|Farms|Studio|Labs|Theatre|Hospital|Garage|Pharmacy|Transport|Electric|Mining|Dairy|Society|Council|Agency|Союз|Завод"
WATERS = {"en": "Lake {}|Loch {}|River {}|Mount {}|{} Bay|{} Hill|{} Lake|{} Valley|the {} Canal|{} Island|Cape {}|Port {}|{} Falls|{} Forest|Fort {}|Castle {}|{} Moor|Isle of {}", "de": "den See {}|den {} See|den Berg {}|die {} Brücke|Schloss {}|Burg {}|am See {}|am Berg {}|im Tal {}|der Fluss {}|die Insel {}|Kloster {}|Bad {}|der Bach {}|am Kanal {}", "fr": "le lac {}|le mont {}|la rivière {}|le canal {}|le château {}|l'île {}|le col {}|la forêt {}|au lac {}|le bois {}|Saint-{}", "es": "el lago {}|el monte {}|el río {}|la sierra {}|el castillo {}|la isla {}|el valle {}|al lago {}|el puerto {}|el bosque {}|San {}|Santa {}", "nl": "het meer {}|de berg {}|de rivier {}|het kanaal {}|kasteel {}|het eiland {}|het bos {}|bij meer {}|de haven {}|de polder {}|fort {}", "ru": "озеро {}|река {}|гора {}|канал {}|замок {}|остров {}|лес {}|долина {}|порт {}|мыс {}"}
MONTHS = {"en": "January|March|April|June|August|October", "de": "Januar|März|April|Juni|August|Oktober", "fr": "janvier|mars|avril|juin|août|octobre", "es": "enero|marzo|abril|junio|agosto|octubre", "nl": "januari|maart|april|juni|augustus|oktober", "ru": "января|марта|апреля|июня|августа|октября"}

# Formats of numbers as countries write them; 0 is any digit, A a capital letter, a a small one, X a digit or capital letter.
PHONES = "000 000 0000|000 000 0000|+44 20 0000 0000|+44 0000 000000|0000 000 0000|00000 000000|(000) 0000 0000|+1 000-000-0000|(000) 000-0000|000-000-0000|000.000.0000|1-000-000-0000|+49 00 00000000|+49 (0)000 0000000|0000/000000|000 0000000|0000 00 00 00|00000-000000|+33 0 00 00 00 00|00 00 00 00 00|00.00.00.00.00|+34 000 000 000|000 00 00 00|000 000 000|+31 00 000 0000|000-0000000|00-00000000|00 0000 0000|+31 (0)00 000 00 00|+7 000 000-00-00|8 (000) 000-00-00|+7 (000) 000 00 00|8-000-000-00-00|0000000000|00000000000|+00000000000|+000000000000|000000000|+43 0 000 0000|+32 000 00 00 00|+41 00 000 00 00|+39 000 000 0000|00000 0000|0 000 000 0000|0000-0000|000 00000|+351 000 000 000|+45 00 00 00 00|0 00 00 00 00 00|(00) 00000-0000|(0000) 000-000|+00 (000) 000 00 00"
IDENTITIES = "000 00 0000|000-00-0000|AA000000A|AA 00 00 00 A|000 000 0000|000000000|AX0X00X00|AX0X00X000|A0000000|AX0000000|00 000 000 000|00000000000|00 000000 A 000|00000000A000|0000000000000|0 00 00 00 000 000 00|0 00 00 00 000 000|000000000000000|00AA00000|000000000000|00000000A|00000000-A|00.000.000-A|A0000000A|A-0000000-A|00/00000000/00|00 00000000 00|0000.00.000|000.000.000|AAXXXXXX0|AA0000000|AA 0000000|A000000|00 00 000000|0000 000000|0000000000|000-000-000 00|AAAAAA00A00A000A|AAAA000000AAAAAA00|00.00.00-000.00|000000-0000|00000000-0000|000.000.000-00|000-000-000|AAAAA0000A|0000 0000 0000|000.0000.0000.00|AAA000000|AA-000000|AAA 000000|0000000A|a0000000a|aa-00-00-00-a|0-0000-00000-00-0|AA 000 000 A"
REFERENCES = "00000000000|000000000000|000-00-00000|000-000-0000|00-0000|AA-0000-000|0000000|A000|AA0000|000/00|0000-00-00000|R-00000|00000000|0000000000|AA000000000AA|00000-00|AAA-00-000|X0X0X0X0|AA00000000|0.000.000|00,000,000|00000|000000|Y000-00|AA/0000/00|0000-000|000000000|00-000-0000|0000.0000|A-00000000"

GIVEN = "Anna|Peter|Maria|Thomas|Laura|Paul|Julia|Martin|Sophie|David|Elena|Lukas|Ingrid|Carlos|Lucía|Pierre|Amélie|Jan|Femke|Willem|Olga|Ivan|Nadia|James|Emily|Robert|Grace|Hassan|Aisha|Mei|Kenji|Priya|Arjun|Zoë|Björn|Łukasz|José|Chloé|Tomasz|Katrin"
FAMILY = "Smith|Jones|Brown|Walker|Müller|Schmidt|Weber|Fischer|Dupont|Martin|Lefèvre|Moreau|García|López|Fernández|Ruiz|Jansen|Visser|Bakker|Smit|Ivanova|Petrov|Sokolov|Kowalski|Nowak|Rossi|Nguyen|Tanaka|Khan|Okafor|Silva|Horvat|Larsson|Øster|Yilmaz|MacLeod|McBride|Fitzgerald"
GIVEN_RU, FAMILY_RU, FATHER_RU = "Анна|Пётр|Мария|Иван|Ольга|Сергей|Елена|Дмитрий|Нина|Олег", "Иванов|Петрова|Смирнов|Кузнецова|Соколов|Попова|Лебедев|Козлова|Новиков|Морозова", "Иванович|Сергеевна|Петрович|Олеговна|Ильич|Дмитриевна"
PARTICLES = "von|van|van der|van den|de|de la|del|da|di|du|ter|le|al|zu|bin"
ONSETS, VOWELS, CODAS = "b|br|c|ch|d|dr|f|fl|g|gr|h|j|k|kl|l|m|n|p|pr|qu|r|s|sch|st|t|th|tr|v|w|y|z|", "a|e|i|o|u|ai|ee|ie|ou|á|é|ü|y", "n|r|s|l|m|t|ck|nd|rt|x||||"
ENDS_NAME = "son|sen|mann|er|ski|ova|ov|ez|ini|eau|ard|ley|ton|o|a|ic|dze|yan|stra|wood|ford|berg|feld|ois|ette|ini|us"
ENDS_TOWN = "ton|ville|burg|ford|stadt|hausen|ham|bury|mouth|port|dorf|dijk|recht|grad|sk|ino|mont|ac|puerto|haven|field|bridge|wick|by|stead|heim|ek|ria"
ENDS_ANY = "|".join(sorted({*ENDS_NAME.split("|"), *ENDS_TOWN.split("|"), *"an|en|in|on|un|ar|er|ir|or|ur|al|el|il|ol|ul|as|es|is|os|us|at|et|it|ot|ut|ak|ek|ik|ok|uk|am|em|im|om|um|ash|esh|ish|ane|ene|ine|one|une|ale|ele|ile|ole|ule|are|ere|ire|ore|ure|ya|ye|yo|ra|re|ri|ro|ru|na|ne|ni|no|nu|la|le|li|lo|lu|ta|te|ti|to|tu|da|de|di|do|du|va|ve|vi|vo|ka|ke|ki|ko|ku|sa|se|si|so|ma|me|mi|mo|sh|th|ch|ll|nn|rr|ss|nk|ng|lt|lm|rn|rk|x|z|y|ey|oy|ay".split("|")}))
PLAIN_ENDS = 0.4
ROOTS = "Garden|King|Victoria|North|School|Church|Maple|Cedar|Harbour|Castle|Bridge|Lincoln|Chapel|Grange|Elm|Station|York|Hill|River|Market|Queen|Forest|Spring"
ENDS_EN = "Street|St|St.|Road|Rd|Lane|Avenue|Ave|Ave.|Close|Drive|Dr.|Way|Crescent|Court|Terrace|Square|Boulevard|Blvd|Place|Gardens|Row|Hill|Walk"
ROOTS_DE, ENDS_DE, FREE_DE = "Bahnhof|Goethe|Haupt|Kirch|Berg|Wald|Friedrich|Rosen|Schiller|Ring|Markt|Eichen|Wiesen|Dorf|Garten|Brunnen|Amsel", "straße|str.|strasse|weg|gasse|allee|platz|ring|damm|ufer|steig", "Am Alten Markt|Unter den Eichen|An der Kirche|Im Winkel|Zum Hafen|Auf dem Berg|Alte Landstraße|Am Bahndamm|Hinter der Mauer"
STREETS_FR, OF_FR = "rue|avenue|av.|boulevard|bd|place|impasse|chemin|allée|quai|route|cours", "de la Gare|du Marché|des Lilas|Victor Hugo|de l'Abbaye|Pasteur|des Écoles|du Moulin|de la Fontaine|Jean Jaurès|des Vignes|du Château|de Bretagne|Saint-Michel"
STREETS_ES, OF_ES = "Calle|C/|Avenida|Avda.|Av.|Plaza|Paseo|Camino|Ronda|Travesía|calle|Carrera", "Mayor|de la Luna|del Carmen|San Juan|de los Olivos|de la Fuente|del Mar|Goya|de Toledo|del Castillo|de la Estación|Nueva|de las Flores"
ROOTS_NL, ENDS_NL, FREE_NL = "Dorp|Stations|Prinsen|Beatrix|Eiken|Haven|Kasteel|Rozen|Water|Markt|Hoog|Wilhelmina|Beuken", "straat|laan|weg|plein|kade|gracht|singel|dijk|hof|steeg|pad", "Oude Markt|Lange Dijk|Nieuwe Haven|Korte Brink"
STREETS_RU, KINDS_RU = "Ленина|Пушкина|Мира|Гагарина|Лесная|Школьная|Центральная|Вокзальная|Новая|Зелёная|Победы|Набережная", "ул.|улица|пр.|проспект|пер.|переулок|бульвар|шоссе|пл."
LATIN, CYRILLIC = "a b v g d e z i j k l m n o p r s t u f h c y w q x".split(), "а б в г д е з и ж к л м н о п р с т у ф х к й в к кс".split()


class Writer:
    """Writes pieces of one text: (value, kind or None)."""

    def __init__(self, rng: random.Random, lang: str) -> None:
        self.rng, self.lang = rng, lang
        self.last = ("", "")

    def pick(self, choices: str) -> str:
        return self.rng.choice(choices.split("|"))

    def odds(self, p: float) -> bool:
        return self.rng.random() < p

    def fill(self, form: str) -> str:
        letters, rng = "ABCDEFGHJKLMNPQRSTUVWXYZ", self.rng
        take = {"0": lambda: str(rng.randrange(10)), "A": lambda: rng.choice(letters), "a": lambda: rng.choice(letters).lower(), "X": lambda: rng.choice(letters + "0123456789")}
        return "".join(take[c]() if c in take else c for c in form)

    def made(self, ends: str) -> str:
        """A pronounceable word that nobody knows."""
        word = "".join(self.pick(ONSETS) + self.pick(VOWELS) + (self.pick(CODAS) if self.odds(0.4) else "") for _ in range(self.rng.randint(1, 2)))
        if self.odds(PLAIN_ENDS):  # names of people, towns and things may end alike
            ends = ENDS_ANY
        return (word + self.pick(ends)).capitalize() if self.odds(0.7) or len(word) < 3 else word.capitalize()

    def person(self) -> str:
        rng, russian = self.rng, self.lang == "ru" and self.odds(0.6)
        given = self.pick(GIVEN_RU) if russian and self.odds(0.5) else self.pick(GIVEN) if self.odds(0.25) else self.made("a|e|o|an|in|us|ine|el|is|ko")
        family = self.pick(FAMILY_RU) if russian and self.odds(0.5) else self.pick(FAMILY) if self.odds(0.25) else self.made(ENDS_NAME)
        if russian:
            given, family = cyrillic(given), cyrillic(family)
        self.last = (given, family)
        if self.odds(0.08):
            given += "-" + (cyrillic(self.made("a|o")) if russian else self.made("a|e|o|an"))
        if self.odds(0.08):
            family += "-" + (cyrillic(self.made(ENDS_NAME)) if russian else self.made(ENDS_NAME))
        if russian and self.odds(0.3):
            father = self.pick(FATHER_RU)
            return rng.choice([f"{given} {father} {family}", f"{family} {given} {father}", f"{family} {given[0]}. {father[0]}.", f"{given[0]}. {father[0]}. {family}"])
        if self.odds(0.05):
            family = rng.choice(["O'", "D'", "O’", "Mc", "Mac"]) + family
        elif self.odds(0.14):
            family = self.pick(PARTICLES) + " " + family
        elif self.odds(0.08):
            family += " " + self.made(ENDS_NAME)
        form = rng.random()
        if form < 0.1:
            return f"{family}, {given}"
        if form < 0.18:
            return f"{family.upper()} {given}" if self.odds(0.6) else f"{given} {family.upper()}"
        if form < 0.3:
            return f"{given[0]}. {family}" if self.odds(0.8) else f"{given[0]}. {rng.choice('ABCDEGHJKLMPRSTW')}. {family}"
        if form < 0.34:
            return f"{family} {given}"
        name = f"{given} {rng.choice('ABCDEFGHJKLMNPRSTW')}. {family}" if self.odds(0.1) else f"{given} {self.made('a|o|an')} {family}" if self.odds(0.05) else f"{given} {family}"
        return name.lower() if self.odds(0.015) else name.upper() if self.odds(0.03) else name.replace(" ", "  ", 1) if self.odds(0.03) else name

    def email(self) -> str:
        rng = self.rng
        ascii_only = lambda x: re.sub("[^a-z]", "", x.lower()) or "info"
        given, family = (ascii_only(x) for x in (self.last if self.last[0].isascii() and self.odds(0.6) and self.last[0] else (self.made("a|o"), self.made(ENDS_NAME))))
        local = rng.choice([f"{given}.{family}", f"{given}{family}", f"{given}_{family}", f"{family}.{given[0]}", f"{given[0]}{family}", f"{given}{rng.randrange(1, 2010)}", f"{family}-{given}", given, family, "info", "office", f"{given}.{family}+{self.word()}", f"{given[0]}.{family}{rng.randrange(99)}"])
        host = ".".join(self.word() for _ in range(rng.choice([1, 1, 1, 2]))) + rng.choice([".com", ".org", ".net", ".de", ".fr", ".es", ".nl", ".ru", ".co.uk", ".test", ".example", ".io", ".edu", ".info", "-group.com", "24.de"])
        way = rng.random()
        if way < 0.06:
            return f"{local} at {host.replace('.', ' dot ')}"
        if way < 0.2:
            sign = rng.choice([" [at] ", "[at]", " (at) ", "(at)", " AT ", " {at} ", " at "])
            return local + sign + (host.replace(".", rng.choice([" [dot] ", "[dot]", " (dot) ", " dot "])) if self.odds(0.4) else host)
        whole = f"{local}@{host}"
        return whole.upper() if self.odds(0.05) else local.capitalize() + f"@{host}" if self.odds(0.07) else whole

    def word(self) -> str:
        return "".join(self.rng.choice("bcdfghklmnprstvw") + self.rng.choice("aeiou") for _ in range(self.rng.randint(2, 4))) + self.rng.choice(["", "n", "s", "x", "r"])

    def street(self) -> str:
        rng, lang = self.rng, self.lang if self.odds(0.88) else self.rng.choice(LANGUAGES)
        n = str(rng.choice([rng.randrange(1, 30), rng.randrange(1, 130), rng.randrange(1, 300)]))
        if lang == "en":
            n = str(rng.randrange(100, 20000)) if self.odds(0.15) else n + (rng.choice("abcdAB") if self.odds(0.12) else "")
            root = self.pick(ROOTS) if self.odds(0.5) else self.made(ENDS_TOWN)
            root += " " + self.pick(ROOTS) if self.odds(0.08) else ""
            out = f"{n} {rng.choice(['N ', 'S ', 'West ', 'Old ', 'Great ', 'St ']) if self.odds(0.1) else ''}{root} {self.pick(ENDS_EN)}"
            unit = f"{rng.choice(['Flat', 'Apt', 'Apt.', 'Unit', 'Suite', 'Apartment', 'Room'])} {rng.randrange(1, 40)}{rng.choice(['', '', 'A', 'B'])}"
            form = rng.random()
            out = f"{unit}, {out}" if form < 0.15 else f"{out}, {unit}" if form < 0.32 else f"{out} #{rng.randrange(1, 40)}" if form < 0.35 else out
            return out.upper() if self.odds(0.1) else out
        if lang == "de":
            n += rng.choice(["a", "b", " c", "c", f"-{int(n) + 2}", f"/{rng.randrange(1, 9)}"]) if self.odds(0.22) else ""
            root = self.pick(ROOTS_DE) if self.odds(0.5) else self.made(ENDS_TOWN)
            form = rng.random()
            if form < 0.15:
                return f"{self.pick(FREE_DE)} {n}"
            if form < 0.3:
                return f"{rng.choice(['Am', 'An der', 'Im', 'Zur'])} {root}{self.pick(ENDS_DE)} {n}"
            return f"{root}{'er ' + rng.choice(['Straße', 'Str.', 'Weg', 'Allee']) if self.odds(0.25) else self.pick(ENDS_DE)} {n}"
        if lang == "fr":
            of = self.pick(OF_FR) if self.odds(0.6) else rng.choice(["de ", "du ", "des ", ""]) + self.made(ENDS_TOWN)
            if self.odds(0.3):  # a name of several words
                of = rng.choice(["du", "de la", "des", "du", "aux", "de l'ancien", "de l'ancienne"]) + " " + rng.choice(["Grand", "Petit", "Haute", "Basse", "Deux", "Trois", "Gros", "Beau", "Belle", "Bon", "Général", "Docteur", "Maréchal", "Onze", "Franc", "Clos", "Pré", "Bas", self.made(ENDS_TOWN), self.made("e|s|es|in"), self.made("e|s|es|in")]) + " " + rng.choice(["Pont", "Prés", "Croix", "Rois", "Chêne", "Port", "Puits", "Tour", "Novembre", "Bois", "Martyrs", *(self.made(ENDS_TOWN + "|e|s|es|on|in") for _ in range(8)), self.made(ENDS_NAME)])
            out = f"{n}{rng.choice([' bis', ' ter', ' B', 'bis']) if self.odds(0.2) else ''}{',' if self.odds(0.35) else ''} {self.pick(STREETS_FR)} {of}"
            return f"{out}, {rng.choice(['appt', 'appartement', 'bât.', 'apt.'])} {rng.choice(['B', 'C', str(rng.randrange(1, 40))])}" if self.odds(0.12) else out
        if lang == "es":
            of = self.pick(OF_ES) if self.odds(0.6) else rng.choice(["de ", "del ", ""]) + self.made(ENDS_TOWN)
            if self.odds(0.15):  # a name of several words
                of = rng.choice(["de los ", "de las ", "del ", "de la ", ""]) + rng.choice(["Doctor", "Tres", "Dos", "Gran", "Santa", "Reyes", "Alta", "Baja", "General", "Nuestra", "Puerta"]) + " " + rng.choice(["Cruces", "Vía", "Católicos", "Señora", "Fuentes", "Torre", self.made(ENDS_TOWN), self.made(ENDS_NAME)])
            out = f"{self.pick(STREETS_ES)} {of}{rng.choice([' ', ', ', ', n.º ', ', nº ', ' núm. '])}{n}"
            return f"{out}, {rng.choice(['{}.º {}', '{}º {}', 'piso {}, puerta {}', '{} {}']).format(rng.randrange(1, 9), rng.choice('ABCDE'))}" if self.odds(0.2) else out
        if lang == "nl":
            n += rng.choice(["a", "b", "-II", "-I", " bis", "-hs", "-2", "A", " B"]) if self.odds(0.25) else ""
            return f"{self.pick(FREE_NL)} {n}" if self.odds(0.15) else f"{self.pick(ROOTS_NL) if self.odds(0.5) else self.made(ENDS_TOWN)}{self.pick(ENDS_NL)} {n}"
        name = self.pick(STREETS_RU) if self.odds(0.6) else cyrillic(self.made("ova|skaja|naja"))
        house = rng.choice([", {}", ", д. {}", ", дом {}", " {}", ", д.{}"]).format(n)
        extra = rng.choice([f", кв. {rng.randrange(1, 200)}", f", корп. {rng.randrange(1, 5)}, кв. {rng.randrange(1, 90)}", f", стр. {rng.randrange(1, 5)}", f", квартира {rng.randrange(1, 99)}"]) if self.odds(0.45) else ""
        return (f"{self.pick(KINDS_RU)} {name}" if self.odds(0.75) else f"{name} {self.pick(KINDS_RU)}") + house + extra

    def grouped_phone(self) -> str:
        """Any country's number in any grouping."""
        rng = self.rng
        between = rng.choice([" ", " ", "-", ".", "/", ""])
        start = rng.choice(["+{}", "00{}", "+{}", "0"]).format(rng.choice(["1", "7", "30", "31", "33", "34", "39", "41", "43", "44", "46", "48", "49", "52", "55", "61", "81", "86", "91", "351", "353", "358", "380", "420"]))
        area = "".join(rng.choice("123456789") for _ in range(rng.randint(1, 4)))
        area = area if start != "0" else "0" + area
        start = "" if start == "0" else start + (between if self.odds(0.8) else " ")
        if start and self.odds(0.12):  # all that follows the country in one run
            return start.rstrip() + rng.choice([" ", " ", "", "-"]) + self.fill("0" * rng.randint(8, 10))
        if self.odds(0.2):
            area = f"({area})" if self.odds(0.5) or not start else f"(0){rng.choice(['', ' '])}{area}"
        rest = [self.fill("0" * rng.randint(2, 5)) for _ in range(rng.randint(1, 3))]
        if sum(c.isdigit() for c in start + area) + sum(map(len, rest)) < 7:
            rest.append(self.fill("0000"))
        return start + area + (between if self.odds(0.7) else rng.choice([" ", "/", "-"])) + between.join(rest)

    def grouped_identity(self) -> str:
        """Digits and letters in any grouping, seven to fourteen of them, more digits than letters."""
        rng = self.rng
        length = rng.randint(7, 14)
        signs = ["0"] * length
        for at in rng.sample([0, 1, 2, length - 1, length - 2, rng.randrange(length)], rng.choice([0, 0, 1, 1, 2, 2, 3])):
            signs[at] = "A"
        between, out, at = rng.choice([" ", " ", "", "-", "."]), [], 0
        while at < length:
            step = rng.randint(2, 5)
            out.append("".join(signs[at:at + step]))
            at += step
        return self.fill(between.join(out))

    def grouped_reference(self) -> str:
        """Some letters and digits in any grouping, as firms number what they have."""
        rng = self.rng
        head = self.fill(rng.choice(["", "", "", "A", "AA", "AAA"]))
        between = rng.choice(["-", "/", ".", "", "", "-"])
        groups = [self.fill("0" * rng.randint(1, 6)) for _ in range(rng.randint(1, 3))]
        return head + (between if head and self.odds(0.5) else "") + (between.join(groups) if between or len(head) else "".join(groups)) + self.fill(rng.choice(["", "", "", "", "A"]))

    def value(self, kind: str) -> str:
        rng = self.rng
        if kind == "P":
            number = self.fill(self.pick(PHONES)) if self.odds(0.6) else self.grouped_phone()
            return number.replace(" ", rng.choice("  ")) if self.odds(0.12) else number
        if kind == "I":
            number = self.fill(self.pick(IDENTITIES)) if self.odds(0.7) else self.grouped_identity()
            number = filled_up(number, rng.randint(1, 5)) if self.odds(0.2) else number
            return number.replace(" ", rng.choice("  ")) if self.odds(0.06) else number
        return {"N": self.person, "E": self.email, "A": self.street}[kind]()

    def plain(self, kind: str) -> str:
        rng = self.rng
        if kind == "n":
            return str(rng.choice([rng.randrange(2, 20), rng.randrange(2, 150), rng.randrange(100, 3000)]))
        if kind == "D":
            return rng.choice([f"{rng.randrange(1, 29)} {self.pick(MONTHS[self.lang])}", f"{rng.randrange(1, 29)} {self.pick(MONTHS[self.lang])} {rng.randrange(1950, 2030)}", self.fill("0.0.2000"), self.fill("20.00.2000"), self.fill("2000-00-00"), self.fill("00/00/2000")])
        if kind == "T":
            town = self.made(ENDS_TOWN)
            town = f"{rng.choice(['Saint ', 'Bad ', 'New ', 'San ', 'Port '])}{town}" if self.odds(0.06) else town
            return cyrillic(town) if self.lang == "ru" and self.odds(0.5) else town
        if kind == "F":
            name = self.made(ENDS_NAME) if self.odds(0.8) else f"{self.made(ENDS_NAME)} & {self.made(ENDS_NAME)}"
            return f"{name} {self.pick(FIRMS)}" if self.odds(0.85) else f"{self.pick(FIRMS[:120].rsplit('|', 1)[0])} {name}" if self.odds(0.3) else f"{name} {self.pick(FIRMS)} {self.pick('Ltd|GmbH|Inc.|SA|BV')}"
        if kind == "G":
            name = self.made(ENDS_NAME + "|" + ENDS_TOWN)
            return self.pick(WATERS[self.lang]).format(cyrillic(name) if self.lang == "ru" and self.odds(0.5) else name)
        if kind == "X":
            noun = self.pick(NOUNS[self.lang])
            if self.odds(0.35):  # a word nobody knows, small as common nouns are, or a capital where German has one
                noun = self.made("a|er|en|um|ik|al") if self.lang == "de" else self.made("a|er|on|um|ik|al").lower()
                noun = cyrillic(noun) if self.lang == "ru" else noun
            if self.odds(0.2):  # a thing of a thing
                other = self.pick(NOUNS[self.lang])
                noun = self.rng.choice(OF_NOUN[self.lang]).format(a=noun, b=other, c=other.lower())
            extra = self.word() + " " if self.odds(0.15) else ""
            extra = cyrillic(extra) if self.lang == "ru" else extra
            return f"{self.pick(DETERMINERS[self.lang]) + ' ' if self.odds(0.8) else ''}{extra}{noun}"
        if kind == "foreign":
            low, high = rng.choice([(0x0621, 0x064A), (0x05D0, 0x05EA), (0x03B1, 0x03C9), (0x0E01, 0x0E2E), (0x3041, 0x3090), (0xAC00, 0xB000), (0x4E00, 0x6000), (0x0905, 0x0939)])
            return " ".join("".join(chr(rng.randint(low, high)) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 5)))
        simple = {
            "H": lambda: rng.choice([self.fill("00:00"), self.fill("0:00"), self.fill("0.00"), f"{rng.randrange(1, 13)} pm", str(rng.randrange(7, 22))]), "Y": lambda: str(rng.randrange(1850, 2030)),
            "m": lambda: rng.choice(["${}", "{} €", "{} EUR", "£{}", "{},50 €", "{}.00", "{} million"]).format(rng.choice([rng.randrange(2, 900), self.fill("0,000"), self.fill("00 000"), self.fill("0.000.000")])),
            "R": lambda: filled_up(self.fill(self.pick(REFERENCES)) if self.odds(0.6) else self.grouped_reference(), rng.choice([0, 0, 0, 0, 0, 1, 2, 3, 4, 5])), "v": lambda: ".".join(str(rng.randrange(rng.choice([4, 10, 30, 200, 2000]))) for _ in range(rng.choice([2, 2, 3, 3, 3, 4]))) + rng.choice(["", "", "", "", "-beta", "rc1"]), "isbn": lambda: self.fill(rng.choice(["978-0-00-000000-0", "9780000000000", "0-000-00000-0"])),
            "file": lambda: rng.choice(["{}@2x.png", "{}@3x.jpg", "{}_1.txt", "{}.zip", "{}@2.0.js", "{}@1x.svg"]).format(self.word() + rng.choice(["", str(rng.randrange(99))])), "w": self.word, "n3": lambda: self.fill("000"), "hex": lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([4, 8, 16, 32]))), "rule": lambda: rng.choice("-=_*~.·#") * rng.randint(3, 40),
        }
        return str(simple[kind]())

    def frame(self, form: str) -> list[tuple[str, str | None]]:
        """A sentence's pieces; its first letter is a capital if an ordinary word stands first."""
        parts: list[tuple[str, str | None]] = []
        self.last = ("", "")
        for i, piece in enumerate(re.split(r"<(\w+)>", form)):
            if not i % 2:
                parts.append((piece, None))
            elif piece in KIND:
                if piece == "N" and self.odds(0.18):
                    parts.append((self.pick(TITLES[self.lang]) + " ", None))
                value = self.value(piece)
                # a point that ends both the value and the sentence stands once
                parts.append((value, KIND[piece]))
            else:
                parts.append((self.plain(piece), None))
        at = next((i for i, p in enumerate(parts) if p[0]), None)
        if at is not None and parts[at][1] is None:
            parts[at] = (parts[at][0][:1].upper() + parts[at][0][1:], None)
        return parts

    def joined(self) -> str:
        """A form of the parts above: most with a name or another value, some with none."""
        rng, lang = self.rng, self.lang
        before, after = self.pick(BEFORE[lang]), self.pick(AFTER[lang])
        if self.odds(0.25):
            before = self.pick(REQUESTS[lang])
        if self.odds(0.5):
            after = self.pick(OBJECTS[lang])
            if self.odds(0.25):
                kind = rng.choice("EPIAA")
                after = f"{self.pick(TOWARDS[kind][lang])} <{kind}>" + (" " + after if self.odds(0.3) else "")
            if lang in ("de", "nl", "es", "ru") and self.odds(0.35):  # the verb before its subject
                before += " " + self.pick(VERBS[lang])
            else:
                after = self.pick(VERBS[lang]) + " " + after
        if self.odds(0.1):
            return self.pick(QUESTIONS[lang])
        if self.odds(0.08):  # things, firms and towns in a row
            both = {"en": "and", "de": "und", "fr": "et", "es": "y", "nl": "en", "ru": "и"}[lang]
            return rng.choice(["<X>: <X>.", "<X>: <X>, <X>.", f"<X>, <X> {both} <X>.", f"{before} {after.lstrip(', ')}: <X>.", "<F>: <X>, <D>, <X>.", f"<T>, <T> {both} <T>: <X>", "<X>; <X>!", f"<F> {after.lstrip(', ')}", f"<F> {after.lstrip(', ')}"])
        draw = rng.random()
        if draw < 0.5:
            who = "<N>"
            if self.odds(0.35):  # in brackets, set off by commas, or coordinated
                other = rng.choice("EPPPIA")
                both = {"en": "and", "de": "und", "fr": "et", "es": "y", "nl": "en", "ru": "и"}[lang]
                who = rng.choice([f"<N> (<{other}>)", f"<N>, <{other}>,", f"<N> {both} <N>", "<N>, <N>", f"<N>: <{other}>", f"<N> (<T>)", f"<N> – <{other}>"])
            form = f"{before} {who}{'' if after[0] == ',' else ' '}{after}" if self.odds(0.7) else f"{who}{'' if after[0] == ',' else ' '}{after}"
        elif draw < 0.72:
            kind = rng.choice("EPIA")
            form = f"{before if self.odds(0.7) else rng.choice(['<N>', '<T>', '<X>'])} {self.pick(TOWARDS[kind][lang])} <{kind}>"
            form += rng.choice([" ", " ", ", <T>", ", <T>, "]) + after.lstrip(", ") if kind == "A" and self.odds(0.4) else " " + after.lstrip(", ") if self.odds(0.4) else ""
        elif draw < 0.85:
            form = f"{before} {self.pick(ORDINARY_AFTER[lang])}" if self.odds(0.7) else self.pick(ORDINARY_AFTER[lang])
        else:
            form = f"{before + ' ' if self.odds(0.5) else ''}{rng.choice(['<T>', '<F>', '<X>', '<R>', '<D>', '<G>', '<T>', '<X>', '<n>', '<n> <X>'])} {after.lstrip(', ')}"
        if self.odds(0.25):
            form += rng.choice([", ", " and " if lang == "en" else ", "]) + self.pick(BEFORE[lang]) + " " + (rng.choice(["<N>", "<N>", "<T>", "<F>", "<X>"]))
        return form + rng.choice([".", ".", ".", "!", "?", "", "…"])

    def listed(self) -> list[tuple[str, str | None]]:
        """Some values one after another, as in a signature, a form, a line of a table or a log."""
        rng, parts = self.rng, []
        self.last = ("", "")
        kinds = rng.sample("NEPIAR", rng.randint(1, 4)) if self.odds(0.6) else [rng.choice("NEPIAR")] if self.odds(0.7) else rng.choices("RRRDv", k=rng.randint(2, 4))
        if "N" in kinds and self.odds(0.6):
            kinds = ["N", *[k for k in kinds if k != "N"]]
        join = rng.choice([", ", ", ", "; ", "\n", "\n", "\n", " | ", " / ", ";", " - ", "\t", ",", " – ", " ("])
        closing = ")" if join == " (" else ""
        labels, sign = rng.random(), rng.choice([": ", ": ", "=", " ", " ", " ", ":"])
        for n, kind in enumerate(kinds):
            parts.append((join if n else "", None))
            if labels < 0.45 or (labels < 0.7 and self.odds(0.5)) or kind in "RDv" or len(kinds) == 1:
                label = self.pick(LABELS[self.lang].get(kind) or {"D": "D.|", "v": "Version|Release|V.|Build|Rev."}[kind])
                if self.odds(0.2):  # any other word
                    label = self.pick(NOUNS[self.lang]).split()[0] if self.odds(0.5) else self.made("a|er|en|um|ik|al")
                    label = label if self.lang == "de" or self.odds(0.5) else label.lower()
                    label = cyrillic(label) if self.lang == "ru" else label
                parts.append(((label.lower() if sign == "=" or self.odds(0.3) else label) + (sign if label else ""), None))
            if kind == "N" and self.odds(0.1):
                parts.append((self.pick(TITLES[self.lang]) + " ", None))
            parts.append((self.plain(kind), None) if kind in "RDv" else (self.value(kind), KIND[kind]))
            if closing and n:
                parts.append((closing, None))
            if kind == "A" and self.odds(0.4):
                parts.append((f", {self.plain('T')}" if self.odds(0.5) else f", {self.fill('00000')} {self.plain('T')}", None))
        if self.odds(0.15):
            parts.append((f"{join}{self.word()}={self.plain('n')}" if sign == "=" else ".", None))
        return parts


def filled_up(number: str, zeros: int) -> str:
    """A number with zeros as its first digits, as registers fill up short ones."""
    return re.sub(r"\d", "0", number, count=zeros) if zeros > 0 and number[:1].isdigit() else number


def cyrillic(text: str) -> str:
    table = dict(zip(LATIN, CYRILLIC))
    return "".join(c if c.lower() not in table else table[c.lower()].capitalize() if c.isupper() else table[c.lower()] for c in text)


def miscode(text: str) -> str:
    """What text looks like after decoding with the wrong table."""
    return text.encode().decode("latin-1")


def training_texts(size: int, seed: int, held_out: dict[str, list[str]] | None = None) -> list[tuple[str, list[Span]]]:
    """`size` texts with the (begin, end, kind) of their values; `held_out`: sentences to take in place of PERSONAL's."""
    rng = random.Random(seed)
    personal = held_out or {lang: forms.split("\n") for lang, forms in PERSONAL.items()}
    ordinary, noise = {lang: forms.split("\n") for lang, forms in ORDINARY.items()}, NOISE.split("\n")
    personal = {lang: [f.replace(r"\n", "\n") for f in forms] for lang, forms in personal.items()}
    noise = [f.replace(r"\n", "\n") for f in noise]
    out = []
    for _ in range(size):
        lang = rng.choices(LANGUAGES, (6, 4, 3, 3, 3, 3))[0]
        gap = rng.choices([" ", "\n", "\n\n", " ", "  ", " "], (80, 8, 3, 4, 3, 2))[0]
        text, spans = rng.choices(["", "  ", "﻿", "<p>", "\t", "- ", "> "], (88, 3, 2, 3, 2, 1, 1))[0], []
        for n in range(rng.randint(1, 4)):
            writer = Writer(rng, lang if rng.random() < 0.94 else rng.choice(LANGUAGES))
            form = rng.random()
            if held_out is None and text[-1:].isdigit() and rng.random() < 0.4:  # another number after one
                parts = writer.frame(f"<n> {writer.pick(NOUNS[writer.lang])} {writer.pick(VERBS[writer.lang])} {writer.pick(OBJECTS[writer.lang])}.")
            elif form < 0.3:
                parts = writer.frame(rng.choice(personal[writer.lang]))
            elif form < 0.42 and held_out is None:
                parts = writer.listed()
            elif form < 0.66 and held_out is None:
                parts = writer.frame(writer.joined())
            elif form < 0.93:
                parts = writer.frame(rng.choice(ordinary[writer.lang]))
            else:
                parts = writer.frame(rng.choice(noise))
            loud = all(k is None for _, k in parts) and rng.random() < 0.05
            text += gap if n else ""
            for value, kind in parts:
                value = value.upper() if loud else value
                if kind:
                    spans.append((len(text), len(text) + len(value), kind))
                text += value
            if text.endswith("..") and parts[-1][0].endswith(".") and len(parts) > 1 and parts[-2][1]:
                text = text[:-1]
        if rng.random() < 0.05 and len(text) > 8:  # cut short; a value that the cut goes through is none
            cut = rng.randrange(len(text) // 2, len(text))
            text, spans = text[:cut], [s for s in spans if s[1] <= cut]
        if text and rng.random() < 0.05:
            text += rng.choice([" 🙂", "</p>", " <|end|>", "\r\n", "   ", " https://" + writer.word() + ".test/?id=77", " …"])
        if rng.random() < 0.05:  # values that change are none
            kept = [(text[:b], text[b:e], k) for b, e, k in spans if text[b:e].isascii()]
            text, spans = miscode(text), [(len(miscode(a)), len(miscode(a)) + len(v), k) for a, v, k in kept]
        out.append((text, spans))
    return out
