"""A few plain sentences in each language, so that no language is without statistics where labelled rows are few."""

# Seed text per primary language subtag.
SEEDS = {
    "en": "the quick answer is that we do not know yet. and then they went home because it was late. what do you think about this? there is nothing we can do with that, but it would be nice to have. she said that he had been there for a long time. the people who live in this house are not at home today. how many of them have you seen, and when did they leave? most of what we need is already here, so let us begin with the first one. if you want to know more about it, you should ask someone who was there. after the meeting they walked through the town and talked about the weather. this is not the same as what he told us last week. she has never been to the other side of the river before. can you hear me, or should i speak louder? there are two or three things which I would like to change. until then nothing will happen, because nobody has the key.",
    "de": "die schnelle antwort ist, dass wir es noch nicht wissen. und dann gingen sie nach hause, weil es spät war. was denkst du darüber? wir können damit nichts machen, aber es wäre schön. sie sagte, dass er schon lange dort gewesen sei. die leute, die in diesem haus wohnen, sind heute nicht zu hause. wie viele von ihnen hast du gesehen, und wann sind sie gegangen? das meiste, was wir brauchen, ist schon hier, also fangen wir mit dem ersten an. wenn du mehr darüber wissen willst, solltest du jemanden fragen, der dabei war. nach der sitzung gingen sie durch die stadt und sprachen über das wetter. das ist nicht dasselbe wie das, was er uns letzte woche gesagt hat. sie war noch nie auf der anderen seite des flusses. kannst du mich hören, oder soll ich lauter sprechen? es gibt zwei oder drei dinge, die ich gern ändern würde. bis dahin passiert nichts, weil niemand den schlüssel hat. warum hat unser nachbar eine neue tür gekauft? mein bruder zeigt dem gast einen brief aus der schule.",
    "fr": "la réponse rapide est que nous ne le savons pas encore. et puis ils sont rentrés chez eux parce qu'il était tard. qu'en pensez-vous ? il n'y a rien que nous puissions faire avec cela, mais ce serait bien. elle a dit qu'il était là depuis longtemps. les gens qui habitent dans cette maison ne sont pas chez eux aujourd'hui. combien d'entre eux as-tu vus, et quand sont-ils partis ? la plupart de ce qu'il nous faut est déjà ici, alors commençons par le premier. si vous voulez en savoir plus, vous devriez demander à quelqu'un qui était là. après la réunion, ils ont marché dans la ville et parlé du temps. ce n'est pas la même chose que ce qu'il nous a dit la semaine dernière. elle n'est jamais allée de l'autre côté de la rivière. est-ce que tu m'entends, ou dois-je parler plus fort ? il y a deux ou trois choses que je voudrais changer. jusque-là rien ne se passera, parce que personne n'a la clé. pourquoi notre voisin a-t-il acheté une nouvelle porte ? mon frère montre une lettre de l'école à l'invité.",
    "es": "la respuesta rápida es que todavía no lo sabemos. y luego se fueron a casa porque era tarde. ¿qué piensas de esto? no hay nada que podamos hacer con eso, pero sería bueno tenerlo. ella dijo que él había estado allí mucho tiempo. las personas que viven en esta casa no están hoy en casa. ¿cuántas de ellas has visto, y cuándo se fueron? la mayor parte de lo que necesitamos ya está aquí, así que empecemos por el primero. si quieres saber más sobre ello, deberías preguntar a alguien que estuvo allí. después de la reunión caminaron por la ciudad y hablaron del tiempo. eso no es lo mismo que lo que nos dijo la semana pasada. ella nunca ha estado al otro lado del río. ¿me oyes, o tengo que hablar más alto? hay dos o tres cosas que me gustaría cambiar. hasta entonces no pasará nada, porque nadie tiene la llave. ¿por qué nuestro vecino compró una puerta nueva? mi hermano le muestra al invitado una carta de la escuela. los niños y las niñas juegan en el parque con su perro. luego el médico explica el resultado de la prueba hacia el final del día. en el pueblo, la mujer del panadero mide la mesa y la silla. sin embargo, ellos también quieren ir a la montaña. ¡qué bonito! ¿de verdad? el valor sube de nuevo, y el señor lo anota en su cuaderno.",
    "pt": "a resposta rápida é que ainda não sabemos. e depois eles foram para casa porque era tarde. o que você acha disso? não há nada que possamos fazer com isso, mas seria bom ter. ela disse que ele estava lá há muito tempo, então não foi à reunião. as pessoas que moram nesta casa não estão hoje em casa. quantas delas você viu, e quando elas saíram? a maior parte do que precisamos já está aqui, então vamos começar pelo primeiro. se você quiser saber mais sobre isso, deve perguntar a alguém que esteve lá. depois da reunião eles caminharam pela cidade e falaram do tempo. isso não é o mesmo que ele nos disse na semana passada. ela nunca esteve do outro lado do rio. você me ouve, ou preciso falar mais alto? há duas ou três coisas que eu gostaria de mudar. até lá não vai acontecer nada, porque ninguém tem a chave. por que o nosso vizinho comprou uma porta nova? o meu irmão mostra ao convidado uma carta da escola. os meninos e as meninas brincam no parque com o seu cachorro. depois o médico explica o resultado do teste perto do fim do dia. na aldeia, a mulher do padeiro mede a mesa e a cadeira. no entanto, eles também querem ir para a montanha. que bonito! é mesmo? o valor sobe de novo, e o senhor anota isso em um caderno.",
    "ru": "быстрый ответ в том, что мы пока не знаем. и потом они пошли домой, потому что было поздно. что ты об этом думаешь? мы ничего не можем с этим сделать, но было бы хорошо. она сказала, что он был там уже давно.",
    "zh": "简单的回答是我们还不知道。然后他们就回家了，因为已经很晚了。你对这个有什么看法？我们对此没有办法，但是如果有的话会很好。她说他在那里已经很久了。这是我们的第一个问题，而那些都不是。",
    "ja": "簡単に言うと、まだ分かりません。それから遅くなったので、みんな家に帰りました。これについてどう思いますか？それについてできることはありませんが、あれば良いでしょう。彼女は彼が長い間そこにいたと言った。",
    "ko": "간단히 말하면 우리는 아직 모릅니다. 그리고 늦었기 때문에 그들은 집으로 갔습니다. 이것에 대해 어떻게 생각합니까? 우리가 할 수 있는 일은 없지만 있으면 좋겠습니다. 그녀는 그가 오랫동안 거기에 있었다고 말했다.",
    "ar": "الجواب السريع هو أننا لا نعرف بعد. ثم ذهبوا إلى البيت لأن الوقت كان متأخرا. ما رأيك في هذا؟ لا يوجد شيء يمكننا أن نفعله بذلك، لكن سيكون من الجيد. قالت إنه كان هناك منذ وقت طويل.",
    "hi": "सीधा जवाब यह है कि हमें अभी पता नहीं है। और फिर वे घर चले गए क्योंकि देर हो गई थी। आप इसके बारे में क्या सोचते हैं? हम इसके साथ कुछ नहीं कर सकते, लेकिन यह अच्छा होगा। उसने कहा कि वह बहुत समय से वहाँ था।",
    "th": "คำตอบสั้นๆ คือเรายังไม่รู้ แล้วพวกเขาก็กลับบ้านเพราะดึกแล้ว คุณคิดอย่างไรกับเรื่องนี้ เราทำอะไรกับมันไม่ได้ แต่ก็คงจะดี เธอบอกว่าเขาอยู่ที่นั่นมานานแล้ว",
}
