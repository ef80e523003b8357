"""Refusals: answers that decline and say nothing else, by alignment with patterns.

A pattern is a row of places, each with the words that may stand there.  ``x!`` must be
in the sentence, ``x?`` may be left out, ``*`` is room for a topic of up to eight words; a name in
capitals stands for a list of words (verbs of helping and telling, words for a request).  So
a pattern says act and object (cannot, will not, must decline; help, answer, discuss, provide), and not
a sentence.  A sentence aligns with a pattern if their longest common subsequence covers
the places that are asked for and leaves few words over.  Japanese is aligned in the same way by characters.

An answer is a refusal if each of its sentences (or clauses) is one, a courtesy, a referral to others or an
acknowledgement, and at least one is a refusal.  A sentence in quotation marks is not the answerer's own.
"""

from __future__ import annotations

import re

from ..functions.text import fold, unwrap

_LISTS = {
    # English
    "HELP": "help assist answer respond reply comply provide give share discuss talk speak comment fulfil fulfill create write produce generate support handle address engage participate continue proceed "
            "offer advise complete process accommodate honor honour grant entertain assisting helping answering discussing talking providing writing creating producing sharing giving responding commenting "
            "engaging explain describe recommend suggest translate do doing go get touch weigh take make tell cover facilitate cooperate speculate compose draft carry deal dealing",
    "TELL": "help assist answer discuss comment advise speak talk respond reply address go get weigh touch helping assisting answering discussing talking write produce provide create generate share support engage",
    "ASK": "this that it these those such your the my any one here request question requests questions topic topics subject subjects matter matters content kind kinds type types sort of thing things information task query "
           "point issue prompt a an in on with about to for from at you at all because as into way kind anything something details specific sensitive further more material text message inquiry area subject now advice opinion opinions medical legal financial personal",
    "NOT": "not t cannot unable never",
    # French
    "AIDER": "aider repondre traiter fournir donner discuter parler aborder commenter satisfaire acceder accepter assister produire ecrire rediger generer creer faire continuer conseiller partager evoquer entrer "
             "aide reponds parle discute fournis traite traitons commente prononcer exprimer expliquer poursuivre",
    "CECI": "ce cet cette ces cela ca ceci votre ta ton tes vos demande demandes question questions sujet sujets point requete requetes theme chose contenu contenus genre type de a sur avec dans en y le la les l d vous t te "
            "la dessus suite ici du des pour information informations precise un une aucune aucun",
    # German
    "HELFEN": "helfen beantworten antworten weiterhelfen geben erteilen leisten liefern bereitstellen besprechen reden sprechen aussern erfullen nachkommen bearbeiten unterstutzen schreiben erstellen diskutieren eingehen "
              "machen tun sagen behandeln kommentieren beraten dienen entsprechen mitteilen verfassen mitwirken weitergeben gebe rede spreche helfe antworte beantworte aussere leiste liefere erstelle sage diskutiere schreibe",
    "DAS": "das dies dieses diese dieser diesen diesem dabei dazu daruber damit darauf hierbei hierzu hier da ihre ihrer deine deiner die der den dem frage fragen anfrage anfragen bitte wunsch thema themen auskunft auskunfte inhalt "
           "inhalte art dir ihnen euch mich mir zu auf bei uber mit solche solchen solcher sowas so etwas weiter punkt angelegenheit einen eine kein keine keinen in angaben information informationen antwort rat sache nicht leider",
    # Spanish
    "AYUDAR": "ayudar ayudarte ayudarle ayudarlo responder responderte contestar contestarte hablar tratar dar darte darle proporcionar proporcionarte ofrecer ofrecerte discutir comentar cumplir atender hacer hacerlo escribir crear "
              "generar entrar asistir asistirte asesorar asesorarte compartir abordar opinar redactar continuar facilitar facilitarte hablare hablo ayudo respondo discuto producir elaborar decir decirte",
    "ESO": "eso esto ese esa este esta esos esas estos estas tu su la el los las lo le te pregunta preguntas peticion solicitud tema temas asunto contenido tipo de del a en con sobre cosa cosas aqui al ello nada mas respuesta un una "
           "ninguna informacion consejo consejos que para por punto consulta",
    # Russian
    "ПОМОЧЬ": "помочь помогать ответить отвечать обсуждать обсудить говорить поговорить рассказать рассказывать предоставить дать давать выполнить выполнять создать создавать написать писать комментировать прокомментировать поддержать "
              "советовать посоветовать делиться поделиться сделать делать продолжать продолжить браться взяться отвечаю обсуждаю говорю помогаю комментирую пишу рассматривать затрагивать касаться",
    "ЭТО": "это этот эта эти этом этим этого этой этому эту таких такие такой таком такого вопрос вопросы вопросу вопроса вопросов просьбу просьба просьбы просьбе запрос запросу запроса запросы запросов тему тема темы теме тем вещи вещах "
           "на с об о по за в вам тебе вас тебя ваш твой вашу твою ваше ничего здесь тут подобные подобных подобного рода содержание материал материалы ответа совет информацию данный данную данной",
}

#: Acts of declining, by language.
REFUSALS = """
i|we can|could|ca|am|m|are|re|will|won|may|must|do|don|ll|shall|is|isn? NOT! be? able|allowed|permitted|willing|going|authorized|authorised|in? a? position? to? HELP! ASK? ASK? ASK? ASK? ASK? ASK?
i|we am|m|are|re|will|ll be? unable! to HELP! ASK? ASK? ASK? ASK? ASK? ASK?
i can|will|won|am|m|do|don|may|must|ll NOT! be? able|allowed|permitted|willing|going|authorized|to? to? TELL! with|about|on|into|to|in|for! *
i am|m|re NOT! allowed|permitted|able|authorized|free|going|supposed to say|disclose|reveal! *
i am|m unable! to TELL! with|about|on|into|to! *
i can|cannot|won|will|refuse|must|may t|not|refuse|cannot!
i|we must|have|ll|will|need|would|m|am|going|to|respectfully|politely? decline|refuse|pass|abstain|refrain|declining! ASK? ASK? ASK? ASK? ASK?
i|we respectfully|politely|must|have|to|will|ll? decline|refuse! to|this|that|from|your|the HELP|ASK? *
i d|would|ll rather|prefer|sooner! NOT! to? *
i prefer|choose! NOT! to *
i have to|must leave|keep|stay|skip! ASK|out|away|alone|unanswered|there|silent? ASK|out|away|alone|unanswered|of? ASK? ASK?
i am|m|do|don|feel|wouldn|would|not NOT! feel|be? comfortable|prepared|ready|inclined! *
that|this|it|such|the|your|these|topics? ASK? ASK? is|s|are|falls|fall|goes|go|lies|outside|sits outside|beyond|against! of? what|my|the i|my|me! *
that|this|it|such|these|those|* is|s|are|isn|aren|not|t? something|topic|subject|one|thing|matter|content|request|area! that? i|we! can|cannot|won|will|don|do|must|m|am|prefer|have|d? NOT|avoid|leave|alone|refuse|decline|produce|off|skip! *
that|this|it|such|these|those s|is|are|isn|aren NOT! something|topic|subject|one|thing|matter|area! i|we|that! *
* is|s a? topic|subject|matter|something i|we! avoid|leave|must|skip|refuse|decline! *
my|our guidelines|guideline|policy|policies|rules|programming|instructions|principles|design|training|safety! do|does|don? not|t? keep|keeps|prevent|prevents|allow|permit|let|forbid|prohibit? me? to|from? HELP|replying? ASK? ASK? ASK? *
that|this|it|doing|answering goes|is|violates|would|breaks|conflicts|runs|contradicts|against|violate|with! my|our! guidelines|policy|policies|rules|programming|instructions|principles|design|values! *
i was|am|m|wasn not|t! built|designed|made|meant|trained|intended|programmed|set! *
i do|don|lack|have|haven not|t|lack|no! have? the|any? ability|capacity|capability|authority|permission|means|clearance! to *
it|that|this would|wouldn|will|isn|is|not|t not|t|inappropriate|irresponsible|wrong|unethical! be? appropriate|right|proper|ethical|responsible|wise|possible|wrong|inappropriate|irresponsible|fair|okay|ok! for? me|i! *
providing|doing|answering|giving|saying|writing that|this|it would|wouldn|is|isn not|t! be? right|appropriate|proper|responsible|ethical|safe|ok|okay! *
no answer|comment|reply|response! can|from|will|on|to|here|me|be|given|i|about? *
i have|can|ll|will|give|offer|make no|nothing! answer|comment|reply|response|opinion|say|give|to|offer|advice! *
i have|ve nothing|no! to? say|add|offer|comment! ASK? *
i ll|will|must|have|to|going|am|m? stop|pass! here|on|there! *
you|we ll|will|d|would|need|have|should|may|must|might|want|better|to ask|consult|find|try|turn|contact|see! somebody|someone|somewhere|elsewhere|anyone|another! else|person|source|expert|about|for? *
ASK? ASK? is|s|are off|not limits|table|up|open! limits|table|for|discussion|to|me|the? ASK? ASK?
i choose|decide|am|m|have|chose|opt|ve|decided to? stay|remain|keep|be silent|quiet|out! *

je|j ne|n! peux|pourrai|pourrais|saurais|puis|suis|veux|souhaite|vais|dois|ai|serai|m|te|vous|y? pas|point? en|mesure|autorise|capable|habilite|le|droit|possibilite|cense|la|pouvoir? a|de|d|en? AIDER! CECI? CECI? CECI? CECI? CECI? CECI?
je|j ne|n! peux|pourrai|saurais|puis|suis|veux|souhaite|vais|parle|reponds|discute pas|point? AIDER! de|sur|a|avec|pour|du|des|d|dans! *
je ne|n peux|veux|pourrai|saurais|puis! pas!
je ne|n peux|veux|puis|dois! rien! dire|ajouter! *
je|j refuse|decline de|d|cette|ce|votre|ta|toute! *
il m|me! est|sera|serait impossible|interdit|difficile! de|d AIDER! *
il ne|n! m|me est|sera pas possible|permis! de|d AIDER! *
je dois|prefere|me|vais|suis|vois|contraint|oblige|de|dans|l|obligation? decliner|refuser|passer|abstenir|abstiens! *
je prefere|prefererais|aime|aimerais|choisis|mieux! autant|mieux? ne|n! pas! *
cette|ta|votre|ce|cela|ca|c|celle|le|la CECI? CECI? est|va|ne? depasse|sort|releve|excede|hors|dela! pas|du|de|le|cadre|ce|la|au|champ|domaine? que|de? mes|mon|ma|je|moi! *
mes|notre|nos|ma consignes|regles|directives|principes|politique|instructions|lignes|programmation! *
mieux|il vaut|faudra|faut|faudrait mieux? demander|adresser|consulter|interroger|voir! a|quelqu|un autre|quelqu|expert|specialiste|autrui! *
c|ce|cela|ca est|n un|pas? sujet|theme|domaine|point|chose|quelque! que|dont|sur|ou|chose je! *
je n ai! pas|rien|aucun|aucune! a|de|le|la|d? dire|droit|reponse|commentaire|capacite|autorisation|ajouter! *
pas|aucun|aucune|sans! de? commentaire|reponse! *

ich kann|darf|werde|mochte|will|konnte|wurde|soll|gebe|rede|spreche|helfe|beantworte|aussere|leiste|sage|habe DAS? DAS? DAS? DAS? DAS? nicht|keine|kein|keinen|nichts|unmoglich! DAS? DAS? DAS? DAS? HELFEN! DAS?
DAS DAS? DAS? kann|darf|werde|mochte|will|gebe|rede|spreche|helfe|beantworte|aussere|konnte|wurde|sage ich! DAS? DAS? nicht|keine|kein|keinen|nichts|ungern! DAS? DAS? DAS? HELFEN? DAS?
kann|darf|mochte|will|werde|konnte|gebe ich! DAS? DAS? DAS? DAS? nicht|keine|kein|keinen|nichts! DAS? DAS? HELFEN! DAS?
ich kann|darf|werde|mochte|will uber|zu|bei|auf|mit|zum|zur! * nicht|keine|nichts! HELFEN! DAS?
ich kann|darf|will|mochte das? nicht!
ich muss|mochte|will|werde|darf|sehe|bin DAS? DAS? DAS? leider? ablehnen|passen|verzichten|absehen|zuruckweisen|verweigern|enthalten|schweigen!
DAS|hier muss|mochte|will|werde ich! DAS? ablehnen|passen|verzichten|absehen|verweigern|enthalten|schweigen!
ich lehne|verweigere|verzichte|passe! *
ich bin|fuhle|wurde DAS? nicht! in|dazu|dafur|fur|wohl|befugt|berechtigt|autorisiert|imstande|ausgelegt|gemacht|der lage|dafur|befugt|berechtigt|autorisiert|imstande|gemacht|gedacht|ausgelegt|wohl|bestimmt|programmiert|vorgesehen! *
es|das|dies|mir ist|steht mir|nicht! nicht|moglich|gestattet|erlaubt|unmoglich|zu! moglich|gestattet|erlaubt|unmoglich|zu! *
mir ist|sind es|das|die? nicht|hande|unmoglich! moglich|gestattet|erlaubt|gebunden|hier? *
das|dies|diese|dieses|ihre|deine DAS? liegt|geht|ist|ubersteigt|fallt|sprengt|uberschreitet|verstosst ausserhalb|uber|nicht|rahmen|hinaus|gegen|dessen|was|unter! ich|meiner|meine|meinen|mir|mich! *
zu|uber|fur|bei|auf|von! * sage|spreche|rede|aussere|gebe|mochte|will|kann|darf ich! DAS? lieber|nichts|nicht|keine|ungern! *
frag|fragen|wende|wenden|sprich|zu|fur|dazu|da|fragst|musst|mussen|solltest|sollten! * jemand|jemanden|anderswo|andere|anderen|anderer! *
meine|unsere|die richtlinien|regeln|vorgaben|grundsatze|programmierung|leitlinien|anweisungen! *
das|dies|es ist DAS? thema|nichts|etwas|gebiet|inhalt|punkt|anliegen! DAS? ich! *
kein|keine kommentar|antwort|auskunft! *
ich ziehe|es|halte|bevorzuge vor|lieber! * nicht|nichts|zuruck|raus|heraus!

no! puedo|podre|podria|voy|debo|quiero|estoy|me|deseo|pienso|tengo|soy|pretendo|sabria|es|resulta|siento! es|a|en|para|me? condiciones|autorizado|autorizada|capaz|posible|permitido|disponible|permiso|comodo|comoda|posibilidad|facultad|dispuesto|dispuesta? de|para|a|con|hablando? AYUDAR! ESO? ESO? ESO? ESO? ESO? ESO?
no! puedo|podre|voy|debo|quiero|estoy|me|pienso! a|es|en? posible|condiciones|de|autorizado? AYUDAR! de|sobre|con|a|en|acerca! *
no puedo|quiero|debo!
no me es|esta|resulta|siento! posible|permitido|comodo|autorizado! *
no estoy|fui|he|soy|sido disenado|autorizado|hecho|preparado|programado|disenada|autorizada|entrenado|facultado|capacitado! *
debo|tengo|voy|prefiero|me|he|quiero|veo|que|a|obligado|de? a? declinar|rechazar|abstenerme|pasar|negarme|rehusar! *
me niego|abstengo|rehuso! *
rechazo|declino! ESO? ESO? ESO? *
prefiero|preferiria|elijo|opto! por? no! *
eso|esto|esa|ese|este|esta|tu|su|lo ESO? ESO? queda|esta|va|excede|sale|sobrepasa|supera|cae|escapa fuera|mas|contra|en|a|mi|de|alla|lo! de? puedo|mi|mis|me|debo|abordo! *
tendras|tienes|tendria|tendra|deberias|debes|mejor|sera que? preguntar|consultar|preguntale|acudir|hablar|buscar|preguntes! a? otra|alguien|otro|otros! *
mis|nuestras|las normas|politicas|directrices|reglas|pautas|instrucciones|principios|programacion! *
es|eso|ese|no un|es? tema|asunto|algo|materia! que|sobre|del|de! debo|no|evito|prefiero|puedo|hablo|toco|hable|pueda|quiera|vaya! *
no tengo! nada|respuesta|comentario|permiso|permitido! *
sin|ningun comentario|comentarios|respuesta! *

я с|об|на? ЭТО? ЭТО? ЭТО? ЭТО? не! могу|смогу|буду|стану|хочу|вправе|имею|готов|готова|в|должен|уполномочен|намерен|возьмусь|собираюсь состоянии|возможности|права|вправе|силах? ЭТО? ЭТО? ПОМОЧЬ! ЭТО? ЭТО? ЭТО? ЭТО? ЭТО? ЭТО?
ЭТО ЭТО? ЭТО? я ПОМОЧЬ? ЭТО? не! могу|смогу|буду|стану|готов|готова|вправе|хочу|отвечаю|помогаю|обсуждаю|говорю! ПОМОЧЬ? ЭТО?
я не! отвечаю|помогаю|обсуждаю|говорю|комментирую|пишу|даю|делюсь|рассказываю! ЭТО? *
я не! могу|буду|стану|хочу|готов! ПОМОЧЬ! о|об|про|на|с|по|к! *
не! могу|смогу|буду ЭТО? ЭТО? ПОМОЧЬ! ЭТО? ЭТО? ЭТО? ЭТО?
я вынужден|вынуждена|должен|должна|предпочту|хотел|хотела|бы|придется? отказаться|отказать|воздержаться|отклонить|промолчать|пропустить! *
вынужден|вынуждена|мне|придется отказаться|отказать|воздержаться|отклонить! *
я отказываюсь|воздержусь|воздерживаюсь|откажусь|пас! *
я предпочитаю|предпочел|предпочла|предпочту бы? не|промолчать|воздержаться! *
мне нельзя|запрещено! *
мне не! разрешено|позволено|положено|дозволено|следует|полагается|хотелось! *
ЭТО ЭТО? выходит|находится|лежит|противоречит|не за|вне|моим|входит! рамки|пределы|пределами|рамками|правилам|вне|принципам|мои|компетенции|в? ЭТО? что|моих|мои|мои|моей|я|меня|правилам|принципам|компетенции|возможностей! *
мои|наши правила|инструкции|принципы|установки|настройки|ограничения! *
ЭТО ЭТО? лучше спросить|узнать|обратиться|задать|спросите|обратитесь! ЭТО? у|к|кого|кому? нибудь|другого|специалиста|другому|кого|эксперта! *
ЭТО не то|та|тема! о|с|что|чем|чего|на|которую|которои? я! *
без комментариев!
"""

#: Sentences and openings that may stand around a refusal and answer nothing.
COURTESIES = """
i hope you understand|ll|will|that|this? understand? *
let me know if *
is|are there anything|something else! *
can|could|may i|we help|assist|do|offer! you? with? something|anything|another|else! *
please? turn|consult|ask|contact|see|speak|reach|talk|seek|refer|try|get! *
i recommend|suggest|advise|encourage|d|would|urge recommend|suggest|advise|encourage|you|asking|consulting|contacting|speaking|urge! *
* can|may|might|could|will|would assist|help you|better|there|with? *
perhaps|maybe * can|could|might|may assist|help|know! *
feel free to *
thank|thanks you? for! *
thank|thanks you for|so|very|much understanding|patience|asking|much!
* again!
* is an|a interesting|good|fair|great|big|tricky|delicate choice|question|topic|subject|one!
you would|d|want|asked|wanted|wish|like like|to|about! *
you asked|want|mentioned about|to|for! *
i|we understand|see|know|appreciate|realize|realise|hear|respect your|that|why|you|this|the! *
i m|am happy|glad|sorry|here|still|able to! help|talk|assist|discuss|hear|answer|chat|with! *
if you have|need|are|want|would|d|feel any|other|something|like|help|to|another|in! *
another|other|a topic|question|subject different? would|is|are|may|works|question! *
i m|am sorry|afraid|really|very|so|truly! *
sorry|apologies|regrettably|unfortunately|hmm|regrets! ASK? ASK?
i apologise|apologize|regret! *
my apologies|regrets! *
with respect|regret|regrets! *
to be plain|clear|frank|honest|blunt
as an assistant|ai|language|artificial|model! *
because|since|as|for|due that|this|it|of|i|to! * my|me|i|guidelines|policy|rules! *
n hesite|hesitez pas! a *
* pourra|pourrait|pourront|saura peut|etre|t|vous|te? aider|renseigner|repondre! *
merci|remercie de|pour|vous|beaucoup! *
excusez|excuse|pardonnez|pardonne moi!
je suis|m|vous|te|prie|demande desole|desolee|navre|navree|excuse|excuser|pardon! *
desole|desolee|navre|malheureusement|pardon|helas! CECI? CECI?
je regrette|comprends|crains! *
toutes|mes|avec|a mes|regret|excuses|regrets! *
en tant qu|que assistant|ia|modele! *
puis|pouvons|peux je|nous aider|faire! *
si vous|tu avez|as|voulez|besoin|souhaitez! *
veuillez|merci|consultez|adressez|demandez|contactez|voyez! *
il vaut|faut|faudrait|serait mieux|preferable! *
es tut mir|sehr! leid!
tut mir leid!
frag|fragen|wende|wenden|stell|stellen sie|dich|mich? gern|gerne|bitte|an|etwas|eine! *
vielleicht * hilft|helfen|weiter|weiterhelfen! *
entschuldigung|leider|verzeihung|entschuldige|entschuldigen|sorry|bedaure|tut! DAS? DAS?
ich bedaure|bitte|verstehe|hoffe|danke|bedauere! *
als assistent|ki|sprachmodell|assistentin|modell|kunstliche! *
kann|konnte|darf ich! sonst|dir|ihnen|anderweitig|bei|noch|helfen! *
danke|vielen fur|dank! *
bitte wenden|fragen|kontaktieren|konsultieren|haben|wende|frag|verstehen! *
wenn|falls du|sie! *
gerne|gern helfe|beantworte|kann! ich! *
te|le|puedo|podemos|puedo ayudo|ayudar|ayudarte|ayudarle! con|en otro|otra|algo|otros! *
tal|quizas|quiza|acaso vez? * pueda|puede|podria|podra ayudarte|ayudar|ayudarle|orientarte! *
lo siento|lamento! mucho? ESO? ESO?
disculpa|disculpe|perdon|lamentablemente|desafortunadamente|perdona|disculpas! ESO? ESO?
lamento|siento|temo|comprendo|entiendo|pido! *
como asistente|ia|modelo|inteligencia! *
espero que! *
gracias por! *
hay algo|alguna! mas|otra|otro|en|que! *
si tienes|tiene|necesitas|quieres|desea! *
por favor! *
consulta|consulte|pregunta|acude|acuda|contacta a|con|al! *
извините|простите|прости|увы|извини|сожалению|сожалею! ЭТО? ЭТО?
к сожалению!
приношу|прошу извинения|прощения! *
мне|очень жаль! *
как помощник|ассистент|языковая|ии|модель|искусственныи! *
могу ли? я! *
надеюсь на|что|вы! *
задаите|задаи|обратитесь|обратись|спросите|проконсультируитесь|попробуите! *
возможно|может|вам|наверное! * сможет|поможет|помочь|подскажет|смогут! *
спасибо|благодарю за! *
я понимаю|сожалею|боюсь|рад! *
если у|вам|вы|нужна|хотите! *
"""

#: Japanese, by characters: endings that decline, and sentences that may stand around them.
JA_REFUSALS = """お答えできません お答えすることはできません お答えできない 答えられません 答えることはできません お手伝いできません お手伝いすることはできません お断りします お断りいたします お断りさせていただきます 応じられません 応じることはできません
お応えできません 回答できません 回答は控えます 回答を控えさせていただきます 回答は差し控えます 対応できません 対応いたしかねます 対応しかねます お答えしかねます お答えいたしかねます お話しできません お話しすることはできません 控えさせていただきます
ご案内できません お力になれません 申し上げられません ご提供できません 提供することはできません コメントできません コメントは差し控えます 引き受けられません お受けできません 許可されていません 許されていません 扱えません 扱うことができません
ご説明できません 助言できません お教えできません 教えられません ご協力できません 範囲を超えています 範囲外です ほかの人に聞いてください 話したくありません 遠慮させていただきます 話題にできません 作成できません ご遠慮ください 触れないことにしています""".split()
JA_COURTESIES = """申し訳ありません 申し訳ございません 申し訳ありませんが 申し訳ございませんが すみません すみませんが ごめんなさい 恐れ入りますが 恐縮ですが 残念ですが 残念ながら 失礼ですが 専門家にご相談ください 専門家に相談してください ご理解ください
ご理解いただけますと幸いです ご了承ください 他にご質問はありますか ほかにお手伝いできることはありますか 他にお手伝いできることがあればお知らせください 別の質問をしてください ほかの話題でしたらお手伝いします 詳しい人に聞いてください アシスタントとして AIとして
ご質問ありがとうございます ありがとうございます ご期待に添えず申し訳ありません お役に立てず申し訳ありません 何か別のことをお聞きください またのご質問をお待ちしています""".split()

_SENT = re.compile(r"(?<=[.!?。！？…])\s*(?=\S)|\n+|[;:；—–]\s+|\.{3,}|,\s+(?=(?:but|however|so|aber|mais|donc|pero|sino|но|а|doch|sondern)\s)")
_COMMA = re.compile(r"[,，、]\s*")
_JOIN = {fold(x) for x in "but however so and aber und mais donc et pero y но а и doch also though yet".split()}
_FILL = {fold(x) for x in "unfortunately really simply just honestly also therefore please then currently leider einfach wirklich malheureusement lamentablemente simplemente sinceramente realmente vraiment просто пожалуйста же ja eben".split()}
_QUOTE = re.compile(r"[\"“„«「『][^\"“”„«»「」『』]+[\"”“»」』]")
_KANA = re.compile("[぀-ヿ]")
#: Words that a slot holds, and the share of words that may be over.
ROOM, OVER = 8, 0.2


def words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", fold(text))


_WORDS = {k: frozenset(fold(w) for w in v.split()) for k, v in _LISTS.items()}


class Pattern:
    """A line of places: what must be there, what is asked for, and what may stand at each."""

    def __init__(self, line: str) -> None:
        self.must: list[frozenset] = []
        self.slots = 0
        places: list[tuple[frozenset, bool]] = []
        for raw in (toks := line.split()):
            if raw == "*":
                self.slots += 1
                continue
            mark = raw[-1] if raw[-1] in "!?" else ""
            ws = frozenset(w for p in raw.rstrip("!?").split("|") for w in (_WORDS[p] if p in _WORDS else {fold(p)}))
            places.append((ws, mark != "?"))
            if mark == "!":
                self.must.append(ws)
        self.head = toks[0] == "*"
        self.asked = [ws for ws, need in places if need]
        self.where, self.where_asked = {}, {}
        for n, (ws, _) in enumerate(places):
            for w in ws:
                self.where[w] = self.where.get(w, 0) | 1 << n
        for n, ws in enumerate(self.asked):
            for w in ws:
                self.where_asked[w] = self.where_asked.get(w, 0) | 1 << n
        self.size = len(places)

    def fits(self, s: list[str], have: set[str]) -> bool:
        if not all(ws & have for ws in self.must):
            return False
        if not self.head and not any(w in self.asked[0] for w in s[:3]):
            return False
        n = len(self.asked)
        if aligned(self.where_asked, n, s) < n - (n > 4):
            return False
        over = len(s) - aligned(self.where, self.size, s)
        return over <= ROOM * min(self.slots, 2) + int(OVER * len(s))


def aligned(where: dict, size: int, s) -> int:
    """Length of the longest common subsequence of a sequence with places that may hold several things."""
    full = (1 << size) - 1
    row = full
    for w in s:
        at = where.get(w)
        if at:
            u = row & at
            row = ((row + u) | (row - u)) & full
    return size - row.bit_count()


def _patterns(text: str) -> tuple[list[Pattern], dict[str, list[int]]]:
    """Patterns, and those to be tried for a word: of what they must hold, the shortest list."""
    ps = [Pattern(x) for x in text.strip().split("\n") if x.strip()]
    by: dict[str, list[int]] = {}
    for n, p in enumerate(ps):
        for w in min(p.must or p.asked, key=len):
            by.setdefault(w, []).append(n)
    return ps, by


_REFUSAL, _REFUSAL_BY = _patterns(REFUSALS)
_COURTESY, _COURTESY_BY = _patterns(COURTESIES)
#: A text without any of these holds no refusal.
_TELLING = frozenset(_REFUSAL_BY)


def _any(s: list[str], ps: list[Pattern], by: dict[str, list[int]]) -> bool:
    have = set(s)
    return any(ps[n].fits(s, have) for n in dict.fromkeys(n for w in s for n in by.get(w, ())))


def _kind(s: list[str]) -> str:
    """refusal, courtesy or other; an opening courtesy and words that only fill are taken off."""
    while s and s[0] in _JOIN:
        s = s[1:]
    s = [w for w in s if w not in _FILL] or s
    if not s:
        return "courtesy"
    if _any(s, _REFUSAL, _REFUSAL_BY):
        return "refusal"
    for n in range(1, min(6, len(s) - 1)):  # an opening without a comma
        if _any(s[:n], _COURTESY, _COURTESY_BY):
            rest = s[n + (s[n] in _JOIN):] if n < len(s) else []
            if len(rest) >= 2 and _any(rest, _REFUSAL, _REFUSAL_BY):
                return "refusal"
    return "courtesy" if _any(s, _COURTESY, _COURTESY_BY) else "other"


def _kinds(part: str) -> list[str]:
    """Of a sentence as a whole or, where that is other, of its parts between commas."""
    k = _kind(words(part))
    if k != "other":
        return [k]
    parts = [p for p in _COMMA.split(part) if words(p)]
    return [_kind(words(p)) for p in parts] if len(parts) > 1 else [k]


def _places(t: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for n, c in enumerate(t):
        out[c] = out.get(c, 0) | 1 << n
    return out


_JA = [(t, _places(t), "refusal") for t in JA_REFUSALS] + [(t, _places(t), "courtesy") for t in JA_COURTESIES]


def _ja_kind(s: str) -> str:
    """By the end of the sentence, which must align by characters; before it a topic may stand."""
    s = "".join(c for c in s if c.isalnum() or c == "ー")
    if not s:
        return "courtesy"
    best = "other"
    for t, where, kind in _JA:
        tail = s[-len(t) - 2:]
        if aligned(where, len(t), tail) >= max(len(t) - 2, 0.85 * len(t)) and s[-1] == t[-1] and len(s) - len(t) <= (30 if kind == "refusal" else 12):
            if kind == "refusal":
                return kind
            best = kind
    return best


def is_refusal(text: str) -> bool:
    t = unwrap(text)
    t = _QUOTE.sub(lambda m: " quotedquoted " if len(m[0]) > 12 else m[0], t)
    kinds: list[str] = []
    if _KANA.search(t):
        for part in re.split(r"(?<=[。！？!?])|\n+|(?<=んが、)|(?<=ですが、)|(?<=ますが、)|(?<=ながら、)|(?<=として、)", t):
            if part and any(c.isalnum() for c in part):
                kinds.append(_ja_kind(part))
                if kinds[-1] == "other":
                    return False
        return "refusal" in kinds
    if _TELLING.isdisjoint(words(t)):
        return False
    for part in _SENT.split(t):
        if part and words(part):
            kinds += _kinds(part)
            if "other" in kinds:
                return False
    return "refusal" in kinds
