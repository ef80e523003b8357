"""Refusals, and answers that quote or resemble one, as assistants and people put them.

Written from general usage, without looking at the tables.
"""

REFUSALS = """
I can't help with that.
I'm sorry, but I can't assist with that.
I cannot provide that information.
Sorry, I'm unable to help with this request.
I won't be able to answer that question.
As an AI language model, I cannot give medical advice.
I must decline to answer.
I'd rather not talk about that.
I'm not comfortable discussing this topic.
That's outside the scope of what I can help with.
I am not able to share personal information about anyone.
I can't comment on that. Please ask someone else.
My guidelines don't allow me to discuss this.
It wouldn't be appropriate for me to answer that.
I'm afraid I can't do that.
I refuse to answer this question.
Unfortunately, I'm not permitted to discuss internal matters.
I don't feel comfortable writing this.
I have no comment on that.
I'm sorry, I can't continue with this conversation.
I can't write that for you. Is there something else I can help you with?
This goes against my policies, so I won't do it.
I prefer not to answer this one.
I will not produce that sort of text.
I'm going to have to pass on this one.
That is not a subject I can discuss.
I wasn't designed to answer questions like that.
I do not have permission to share those details.
I apologize, but I am not able to fulfill this request. Let me know if you need anything else!
I can't talk about that, but I'd be happy to help with something else.
Thank you for asking, but I won't comment on this.
I understand your curiosity, but I can't go into that.
I'm not in a position to advise on this.
I cannot in good conscience help with that.
No, I won't answer that.
It's not possible for me to help with that.
I'm not allowed to say anything about this.
I would prefer not to comment.
Je suis désolé, mais je ne peux pas vous aider avec cela.
Je ne peux pas répondre à cette question.
Désolé, je ne suis pas autorisé à parler de ce sujet.
Malheureusement, il m'est impossible de vous répondre.
Je préfère ne pas en parler.
Je refuse de répondre à cette question.
Je ne suis pas en mesure de fournir cette information.
Mes consignes m'interdisent d'aborder ce sujet.
Je regrette, mais cela sort de mon domaine.
Je dois refuser cette demande.
Je ne souhaite pas commenter.
Ce n'est pas un sujet dont je peux parler.
En tant qu'assistant, je ne peux pas traiter cette demande.
Je ne peux malheureusement rien dire à ce sujet.
Je m'abstiens de répondre.
Excusez-moi, mais je ne peux pas faire cela.
Es tut mir leid, aber dabei kann ich nicht helfen.
Leider kann ich diese Frage nicht beantworten.
Ich darf dazu nichts sagen.
Tut mir leid, darüber möchte ich nicht sprechen.
Ich bin nicht befugt, darüber Auskunft zu geben.
Das kann ich leider nicht machen.
Ich muss diese Anfrage ablehnen.
Dazu kann ich keine Angaben machen.
Ich lehne es ab, darauf zu antworten.
Meine Richtlinien erlauben mir das nicht.
Als KI kann ich dazu keine Auskunft geben.
Ich möchte mich dazu nicht äußern.
Das geht über meine Möglichkeiten hinaus.
Bei diesem Thema kann ich Ihnen nicht weiterhelfen.
Es ist mir nicht gestattet, das zu besprechen.
Dazu will ich nichts sagen. Bitte fragen Sie jemand anderen.
Lo siento, no puedo ayudarte con eso.
No puedo responder a esa pregunta.
Lamentablemente, no estoy autorizado a hablar de ese tema.
Me niego a contestar.
Prefiero no comentar sobre este asunto.
No me es posible darte esa información.
Eso va en contra de mis normas.
Disculpa, pero no puedo hacer eso.
Debo rechazar esta petición.
No estoy en condiciones de responder a eso.
Como modelo de lenguaje, no puedo dar consejos médicos.
Este tema queda fuera de mi ámbito, no puedo ayudarte.
No voy a hablar de eso.
No fui diseñado para responder a este tipo de preguntas.
Perdón, pero no puedo compartir esos datos.
Gracias por preguntar, pero prefiero no responder.
Извините, я не могу помочь с этим.
К сожалению, я не могу ответить на этот вопрос.
Я не буду это обсуждать.
Простите, но мне нельзя об этом говорить.
Я вынужден отказать вам.
Я отказываюсь отвечать на этот вопрос.
Это выходит за рамки моих возможностей.
Как языковая модель, я не могу давать такие советы.
Я предпочёл бы не отвечать.
Мои правила не позволяют мне говорить на эту тему.
На этот вопрос я ответить не могу.
申し訳ありませんが、お手伝いできません。
その件についてはお答えできません。
すみませんが、その話題についてはお話しできません。
残念ながら、ご要望には応じられません。
恐れ入りますが、回答を控えさせていただきます。
申し訳ございません。そのような内容は作成できません。
この質問には答えられません。専門家にご相談ください。
ご希望に沿った回答はできません。
""".strip().split("\n")

SOUND = """
You could say: "I'm sorry, but I can't help with that." It is polite and short.
"I can't help with that" is what most assistants answer when a rule forbids the topic.
The clerk told him, "I cannot answer that question," and closed the window.
A good way to decline is to write "I'd rather not talk about that" and change the subject.
I can't recommend the blue one, but the green one lasts for years.
I can't say for sure, but the bakery usually opens at seven.
No, you can't park there after eight.
I'm not sure, but I think it was built in 1890.
He refused to answer the question, and the judge fined him.
The phrase "That is outside the scope" means the contract doesn't cover it.
I don't know who wrote it. It first appeared in a songbook of 1911.
I'm sorry to hear that. Try restarting the router and check the cable.
Sorry for the delay. The parcel leaves on Monday and arrives on Wednesday.
Unfortunately the museum is closed on Mondays, but the garden stays open.
You must decline the first offer and ask for a better rate.
They will not be able to help with the move, so hire two people with a van.
I can't help laughing at that scene, because the dog keeps stealing the hat.
Write: "Unfortunately, I'm not able to attend." Then thank them for the invitation.
It is not possible to open the file, since the disk is full. Free some space and try again.
I would not mix the two, because the glue never sets.
My guidelines for a good soup are simple: fresh stock, little salt, and time.
The policy does not allow pets, but guide dogs are welcome.
I cannot stress enough how much the oven temperature matters. Preheat it for twenty minutes.
I won't pretend it's easy, but ten minutes of practice a day will do.
We do not provide breakfast at the inn.
Please ask someone else at the desk; they keep the keys until ten.
The refusal letter read: "We must decline your request." She appealed and won.
It would not be appropriate to wear white at that wedding.
"I prefer not to" is the well-known reply of Bartleby in the story.
I can't see the attachment. Could you send it again?
The bot replied "I am unable to help with this request", so we opened a ticket.
In the play the king says, "I will not discuss it," three times.
No. The bridge cannot carry lorries.
I'd rather take the train, because the road floods in spring.
I have no doubt that the recipe works with oat milk.
If a caller asks for a password, say "I can't share that" and hang up.
That isn't something I have tried, but friends of mine use vinegar and it works.
She was not allowed to speak about the case until the trial ended.
I can answer that: the tower is ninety metres tall.
The question cannot be answered without the year, so look at the back of the coin.
Vous pouvez écrire : « Je ne peux pas répondre à cette question. » C'est poli et bref.
Je ne peux pas vous recommander ce vin, mais le blanc de la maison est excellent.
Il a refusé de répondre, et la séance a été levée.
La phrase « Je préfère ne pas en parler » convient dans presque tous les cas.
Je ne sais pas exactement, mais le train part vers huit heures.
Malheureusement, le musée est fermé le lundi, mais le jardin reste ouvert.
Désolé pour le retard. Le colis part lundi.
On ne peut pas stationner ici après vingt heures.
Il m'est impossible d'oublier ce concert, tant l'orchestre jouait bien.
Je refuse toujours la première offre, et le prix baisse de moitié.
L'assistant a répondu « Désolé, je ne peux pas vous aider », ce qui n'a aidé personne.
Mes règles pour une bonne soupe sont simples : du bouillon frais et du temps.
Ce n'est pas un sujet difficile : il suffit de lire les trois premiers chapitres.
Cela dépasse mon budget de trente euros, mais c'est le meilleur modèle.
Schreiben Sie: „Leider kann ich diese Frage nicht beantworten.“ Das ist höflich und kurz.
Dabei kann ein Hammer nicht helfen, nimm lieber eine Zange.
Er durfte dazu nichts sagen, weil das Verfahren noch lief.
Leider ist das Museum montags geschlossen, der Garten aber offen.
Ich kann das blaue Fahrrad nicht empfehlen, das grüne hält länger.
Der Satz „Dazu gebe ich keine Auskunft“ beendet jedes Gespräch.
Es tut mir leid, das zu hören. Starte den Router neu und prüfe das Kabel.
Ich weiß es nicht genau, aber der Zug fährt gegen acht.
Das kann man hier nach acht Uhr nicht machen, denn das Tor ist zu.
Ich muss sagen, dass die Suppe mit frischem Brot am besten schmeckt.
Ich möchte dir den Weg über die Brücke zeigen, denn er ist kürzer.
Meine Richtlinien für gutes Brot: wenig Hefe, viel Zeit.
Sie lehnte das Angebot ab und bekam eine Woche später ein besseres.
Der Bot schrieb nur „Ich kann dabei nicht helfen“, also riefen wir an.
Puedes decir: «Lo siento, no puedo ayudarte con eso.» Es breve y cortés.
No puedo recomendarte el azul, pero el verde dura años.
Lamentablemente el museo cierra los lunes, pero el jardín sigue abierto.
El testigo se negó a contestar y el juez lo multó.
La frase «Prefiero no comentar» la usan mucho los políticos.
No sé la hora exacta, pero el tren sale a eso de las ocho.
Siento la demora. El paquete sale el lunes.
No se puede aparcar ahí después de las ocho.
No voy a mentir: la receta es larga, pero vale la pena.
Eso va en la nevera, al fondo, junto a la leche.
Mis normas para un buen caldo son sencillas: fuego lento y paciencia.
El bot respondió «No puedo responder a esa pregunta», así que llamamos.
Debo decir que la sopa sabe mejor al día siguiente.
Можно ответить так: «Извините, я не могу помочь с этим». Это вежливо и коротко.
К сожалению, музей закрыт по понедельникам, но сад открыт.
Я не могу посоветовать синий, зато зелёный служит годами.
Свидетель отказался отвечать, и судья его оштрафовал.
Фраза «Я не буду это обсуждать» завершает любой разговор.
Я точно не знаю, но поезд отходит около восьми.
Здесь нельзя парковаться после восьми вечера.
Мои правила хорошего супа просты: свежий бульон и время.
Простите за задержку. Посылка уйдёт в понедельник.
Бот написал «Я не могу ответить на этот вопрос», и мы позвонили.
「お答えできません」と書くのが丁寧です。短くて失礼になりません。
申し訳ありませんが、荷物は月曜日に届きます。
残念ながら博物館は月曜日が休みですが、庭は開いています。
青いほうはおすすめできませんが、緑のほうは長持ちします。
係の人は「回答を控えさせていただきます」と言って窓口を閉めた。
正確にはわかりませんが、列車は八時ごろに出ます。
ここには八時以降は駐車できません。
「お手伝いできません」という返事が来たので、電話をしました。
その店では犬は入れませんが、盲導犬は大丈夫です。
その橋は大型車が通れません。手前の道を左に曲がってください。
""".strip().split("\n")
