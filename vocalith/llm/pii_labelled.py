"""The labelled table the tagger of personal data is trained on: one sentence a line, pieces in {kind:...}.

Names are common ones of their languages and the places are made up. ``expanded`` multiplies the table by exchanging pieces of one kind and script, most of them by
random words and characters, so that the field learns where a piece stands and what shape it has, not which names there are.
"""

from __future__ import annotations

import random
import re

# Labelled sentences.
SENTENCES = """
My name is {name:Desmond Baumgartner}.
주소는 {addr:한울시 중앙로 81} 입니다.
저는 {addr:한울시 벚꽃길 12} 에 살아요.
제 주소는 {addr:양평군 은행로 3번길 9} 이에요.
소포는 {addr:한울시 은행로 27번길 4} 앞으로 보내 주세요.
{name:王静敏}話聽日會嚟。
{name:楊超}話會帶埋部機過嚟㗎。
{name:李杰}会把箱子带过来。
{name:edgar whitcombe}: I think the caller wants the tapes back.
{name:alma ferreira}: the second file has to be checked again.
{name:HELENA NOVAK}: um, we never got the summary.
{name:ingrid novak} apportera les cassettes.
{name:pascal sandoval} bringt die Bänder mit.
{name:박나래솔}: 녹음이 중간에 끊겼어요.
{name:高橋直樹}: もう一度聞いてみましょう。
My name is {name:Tobias Z. Rutherford}.
this is {name:Leopold Castellano} speaking.
this is {name:Lucinda Delacroix} speaking. my address for mail is {email:thornbury46@mailhouse.example}, all lower case.
Could you put me through to {name:Caroline Whitcombe} please?
Could you put me through to {name:Leopold U. Delacroix} please?
Mr {name:Marisol Ferreira} asked for the transcript.
Mrs {name:Ingrid van der Meer} asked for the transcript.
Ms {name:Yvonne K. Novak} asked for the transcript.
Thanks, {name:Gregor Rutherford}, that helps.
The caller gave the name {name:Victor Lindqvist} twice.
The caller gave the name {name:edgar castellano} twice.
Thanks, {name:bernard novak}, that helps.
Thanks, {name:ingrid whitcombe}, that helps. It took 42 minutes to find the left channel in the annex.
{name:casimir whitcombe} apportera l'appareil.
{name:tobias thornbury} will bring the recorder.
Was it {name:Alma O'Malley} who signed for the tapes?
{name:Helena Thornbury} will bring the recorder.
{name:Tobias Hart-Davies} will bring the recorder.
{name:Caroline Gustafsson}: When the noise filter sounds muffled, the site manager had to start over.
{name:Marisol O'Malley}: Ich glaube, der Fahrer war heute früh neben der Laderampe.
{name:Bernard Ferreira}: De la minute 33 à la minute 59 on n'entend que le câble vexken.
{name:Lucinda Kowalczyk}: Todavía no sabemos por qué el filtro de ruido se cortó.
{name:Pascal Rutherford}: ähm, Ich glaube, unser Praktikant war letzte Woche im vierten Stock.
{name:Casimir van der Meer}: We still don't know why the meeting room mic looks fine to me in the small studio.
{name:Ingrid Thornbury}: 녹음기는 {addr:한울시 은행로 12번길 8} 앞으로 보내 주세요.
{name:Marisol Rutherford}: 我的电话是{phone:+999 17 555 0174}，请回电。
{name:王明}: 第4分钟到第9分钟全是PN-169设备的嗡嗡声。
{name:李敏}: 我先说明一下，那段很长的采访处理到一半就失败了，但是没有人发现。
{name:趙強靜}: 我諗後勤嗰邊將份摘要擺咗喺上落貨區隔籬。
{name:김가온빛}: 왜 그런지 몰라도 자막 파일만 먹먹하게 들려요.
{name:이서연}: 보관 폴더에서 12개 정도가 빠져 있어요.
{name:渡辺 陽子}: 左チャンネルを12番の棚に移してもいいですか。
{name:高橋健太}: 先週もう一度左チャンネルを聞いてみましょう。
Mein Name ist {name:Bernard Castellano}.
Verbinden Sie mich bitte mit Frau {name:Pascal Sandoval}.
Verbinden Sie mich bitte mit Herrn {name:Rufus Lindqvist}.
{name:Caroline Hart-Davies} bringt das Gerät mit.
Je m'appelle {name:Yvonne Kowalczyk}.
Passez-moi Mme {name:Lucinda Delacroix}, s'il vous plaît.
Passez-moi M. {name:Bernard Novak}, s'il vous plaît.
{name:Edgar Baumgartner} apportera l'appareil.
Me llamo {name:Gregor Baumgartner}.
Póngame con la señora {name:Leopold O'Malley}, por favor.
Póngame con el señor {name:Annika Ferreira}, por favor.
{name:Casimir Sandoval} traerá la grabadora.
请帮我转接{name:陈明芳}先生。
请帮我转接{name:Desmond Sandoval}先生。
我叫{name:王超}。
我叫{name:张娟伟}。
我叫{name:Helena Novak}。
来电人自称{name:王敏芳}，说过两遍。
谢谢{name:张静}，这样就清楚了。
谢谢{name:Casimir Thornbury}，这样就清楚了。
{name:李芳}会把录音笔带过来。
{name:陈强静}会把录音笔带过来。
我叫做{name:张伟敏}呀。
唔該搵{name:黄敏芳}先生。
{name:刘娟娟}話會帶部機過嚟。
{name:趙傑}嚟㗎。
{name:Pascal Whitcombe}嚟㗎。
多謝{name:黄超杰}，咁就清楚喇。
私は{name:佐々木 美由紀}と申します。
私は{name:高橋健太}と申します。
{name:松ヶ枝 健太}さんにつないでください。
{name:Tobias Castellano}さんにつないでください。
{name:中村直樹}さんにつないでください。
録音機は{name:石川 陽子}が持って来ます。
録音機は{name:渡辺翔平}が持って来ます。
제 이름은 {name:박나래솔}입니다.
제 이름은 {name:Tobias Sandoval}입니다.
제 이름은 {name:Annika H. Castellano}입니다.
{name:Pascal M. Hart-Davies}: uh, The site manager said that the left channel sounds muffled.
{name:Alma Y. Lindqvist} will bring the recorder.
谢谢{name:Victor A. Hart-Davies}，这样就清楚了。
녹음기는 {name:김민준} 씨가 가져옵니다.
녹음기는 {name:Alma Castellano} 씨가 가져옵니다.
{name:이가온빛} 님 바꿔 주세요.
{name:Rufus Baumgartner} 님 바꿔 주세요.
Send the summary to {email:edgar_castellano@postbox.example}.
Send the summary to {email:gregor underscore kowalczyk at mailhouse dot example}.
Send the summary to {email:baumgartner90 at norden-media dot invalid}.
You can write to {email:castellano48 @ mailhouse.example} for the file.
You can write to {email:edgar.gustafsson [at] norden-media [dot] invalid} for the file.
Anything for {email:o.malley-annika @ lakeside.test} goes through me.
Anything for {email:gustafsson-tobias＠lakeside.test} goes through me.
Copy <{email:CASTELLANO71@POSTBOX.EXAMPLE}> on that.
Copy <{email:pascal_castellano [at] mail [dot] ironbridge [dot] example}> on that.
my address for mail is {email:lucinda+calls [at] norden-media [dot] invalid}, all lower case.
Bitte schicken Sie alles an {email:desmond_kowalczyk＠lakeside.test}.
Bitte schicken Sie alles an {email:thornbury65 at lakeside dot test}.
Envoyez tout à {email:snovak@mail.ironbridge.example}, merci.
Envoyez tout à {email:gregor_hart.davies @ postbox.example}, merci.
Mándelo todo a {email:tsandoval at mailhouse dot example}, gracias.
Mándelo todo a {email:vandermeer-helena@norden-media.invalid}, gracias.
文件请发到{email:thornbury82 @ postbox.example}。
文件请发到{email:JCASTELLANO@MAILHOUSE.TEST}。
我的邮箱是{email:gustafsson04 at mailhouse dot example}，谢谢。
我個電郵係{email:SANDOVAL-INGRID@MAILHOUSE.EXAMPLE}。
我個電郵係{email:edgar+calls＠postbox.invalid}。
唔該將個檔案send去{email:lindqvist-tobias@postbox.example}。
メールは{email:castellano37 at mail dot ironbridge dot example}です。
メールは{email:helena.ferreira@lakeside.test}です。
資料は{email:ingrid+calls@mail.ironbridge.example}までお願いします。
메일은 {email:lrutherford at postbox dot example} 입니다.
메일은 {email:thornbury-desmond@norden-media.invalid} 입니다.
파일은 {email:casimir dot sandoval at lakeside dot test} 주소로 보내 주세요.
파일은 {email:jdelacroix @ lakeside.test} 주소로 보내 주세요.
my number is {phone:(690) 555 0128}.
my number is {phone:three nine one five five five zero one eight three}.
Text {phone:938-555-0143} when the upload is done.
Text {phone:009993865550128} when the upload is done.
Text {phone:+1 (062) 555-0104} when the upload is done.
Call me back on {phone:+999 78 555 0171} after six.
Call me back on {phone:313.555.0130} after six.
Call me back on {phone:six two three five five five zero one eight four} after six.
Call me back on {phone:oh six two, five five five oh one one two} after six.
Text {phone:nine one five, five five five, zero one two one} when the upload is done.
The callback number is {phone:020 555 0150}.
{phone:+1 (359) 555-0199} is the best way to reach us.
{phone:709.555.0193} is the best way to reach us.
{phone:(083) 555 0107} is the best way to reach us.
Sie erreichen mich unter {phone:１５４－５５５０１１２}.
Sie erreichen mich unter {phone:008 555 0154}.
Sie erreichen mich unter {phone:drei neun eins fünf fünf fünf null eins acht drei}.
Die Rückrufnummer lautet {phone:009999155550193}.
Die Rückrufnummer lautet {phone:+999 33 555 0119}.
Rappelez-moi au {phone:049 555 0147}.
Rappelez-moi au {phone:six zéro quatre cinq cinq cinq zéro un deux sept}.
Mon numéro est le {phone:+1 (276) 555-0151}.
Mi número es el {phone:009996615550184}.
Mi número es el {phone:siete dos tres cinco cinco cinco cero uno ocho cuatro}.
Llámeme al {phone:702-555-0197}.
Llámeme al {phone:(715) 555 0113}.
我的电话是{phone:036 555 0127}，请回电。
我的电话是{phone:六二三五五五零一八四}，请回电。
联系电话：{phone:+999 62 555 0182}。
联系电话：{phone:三一二五五五零一六七}。
联系电话：{phone:(592) 555 0170}。
打返{phone:239-555-0161}畀我啦。
我電話係{phone:+999 90 555 0124}，得閒覆我。
我電話係{phone:七一二五五五零一三六}，得閒覆我。
電話番号は{phone:六一五五五五零一六三}です。
電話番号は{phone:712.555.0164}です。
折り返しは{phone:009998885550140}へお願いします。
折り返しは{phone:020 555 0131}へお願いします。
電話番号は{phone:+1 (316) 555-0145}です。
{phone:010 555 0124} 번으로 다시 걸어 주세요.
{phone:+1 (386) 555-0110} 번으로 다시 걸어 주세요.
전화번호는 {phone:３０３－５５５０１２４} 입니다.
전화번호는 {phone:993.555.0149} 입니다.
전화번호는 {phone:공이삼 오오오 공일이구} 입니다.
My identity number is {id:QJ281078(0)}.
My identity number is {id:QQ 15 17 17 D}.
My identity number is {id:82.031.887-X}.
ID on file: {id:000-02-0765}.
ID on file: {id:XZ3057875}.
{id:XZ6311456} is what I read off the passport.
{id:04.579.694-Z} is what I read off the passport.
{id:QQ 81 92 49 B} is what I read off the passport.
the card says {id:000-98-3024}.
the card says {id:46.951.714-K}.
Die Ausweisnummer ist {id:XQ7044145}.
Die Ausweisnummer ist {id:00.331.902-K}.
Ma carte porte le numéro {id:QX011779(8)}.
Ma carte porte le numéro {id:000-83-4926}.
Mi documento es el {id:000-57-5298}.
Mi documento es el {id:QQ 49 81 64 D}.
身份证号码是{id:00492319030230255X}。
身份证号码是{id:XZ7501374}。
证件上写的是{id:005312199011304417}。
证件上写的是{id:QW962972(5)}。
我身份證號碼係{id:QX528641(2)}呀。
我身份證號碼係{id:004923190302302551}呀。
本人確認の番号は{id:58.313.921-X}です。
本人確認の番号は{id:QQ 07 85 79 C}です。
本人確認の番号は{id:000-66-5658}です。
주민 번호는 {id:900230-3649715} 이고요.
주민 번호는 {id:QW788214(3)} 이고요.
I live at {addr:198 Mill Bank Road}.
I live at {addr:Flat 1A, 84 Cedar Avenue, North Ashby}.
I live at {addr:170 Lower Market St., Saint Albury QX9 09ZZ}.
I live at {addr:255 Clover Lane, Brackendale}.
Please ship it to {addr:68 Abbey Close} before Friday.
Please ship it to {addr:Flat 8B, 103 Windermere Row, Brackendale} before Friday.
Please ship it to {addr:15 Heather Court, North Ashby QX7 03ZZ} before Friday.
{addr:82 Abbey Close} is where the van should stop.
{addr:128 Cedar Avenue} is where the van should stop.
{addr:37 Lower Market Street} is where the van should stop.
{addr:57 Windermere Row, Saint Albury} is where the van should stop.
{addr:Flat 9C, 248 Mill Bank Road, Port Ellery} is where the van should stop.
{addr:134 Cedar Ave, Port Ellery QX9 07ZZ} is where the van should stop.
Ich wohne in der Anschrift {addr:Lindenweg 176, 00929 Neuhausen}.
Ich wohne in der Anschrift {addr:Alte Korngasse 215}.
Das Gerät geht an: {addr:Kastanienallee 111}.
Ich wohne in der Anschrift {addr:Kastanienallee 4}.
Das Gerät geht an: {addr:Alte Korngasse 223, 00309 Neuhausen}.
J'habite au {addr:160 allée des Cygnes}.
J'habite au {addr:45 rue des Lilas, 00353 Montclair}.
J'habite au {addr:98 bis rue des Lilas}.
L'appareil part au {addr:17 bis rue des Lilas}.
J'habite au {addr:20 bis impasse du Vieux Puits}. Nous ne savons pas encore pourquoi le brouillon est revenu propre.
L'appareil part au {addr:250 bis allée des Cygnes}.
L'appareil part au {addr:67 impasse du Vieux Puits, 00535 Montclair}.
Vivo en {addr:calle del Olivo, 236, 00459 Villanueva}.
Vivo en {addr:plaza del Molino Viejo, 241, 2.º B}.
El aparato va a {addr:avenida de las Palomas, 208}.
我住在{addr:南江市桂花巷12号}。
我住在{addr:长安大街8号3栋201室}。
录音笔请寄到{addr:平山县中山路15号2栋504室}。
录音笔请寄到{addr:桂花巷7号}。
录音笔请寄到{addr:长安大街6号}。
我住在{addr:中山路98号}。
The callback line was {phone:０７６－５５５０１２９}, she said.
我住喺{addr:彌敦道18號海景閣9樓C室}。
我住喺{addr:桂花里7號}。
部機寄去{addr:廣東街22號}就得喇。
部機寄去{addr:彌敦道3號海景閣12樓B室}就得喇。
住所は{addr:桜ヶ丘町若葉町3-2-14}です。
住所は{addr:青山市北本町1-8-22}です。
録音機は{addr:青山市緑台2-5-9}に送ってください。
録音機は{addr:桜ヶ丘町北本町4-11-3}に送ってください。
저는 {addr:양평군 벚꽃길 14번길 22} 에 살아요.
저는 {addr:한울시 중앙로 81} 에 살아요.
녹음기는 {addr:양평군 은행로 12} 앞으로 보내 주세요.
The kintdentta adapter from the site manager arrived with 79 spare clips around half past nine.
When the lecture feed looks fine to me, the choir director had to start over.
We still don't know why the morning bulletin failed halfway through on the fourth floor.
Could we move the draft summary to the shelf near the loading dock?
I think someone from facilities left the meeting room mic at the river depot at 10:30.
The site manager wants the noise filter and our backup drive sorted out during the night shift.
Between minute 82 and minute 57 the douskem hum covers everything, for what it's worth.
Set the bomtrind knob to 14.79 and try our backup drive again.
Let's listen to the printed agenda once more during the night shift, to be honest.
Our intern plugged the pirkgrent cable into the gantwalt splitter in the small studio.
Someone from facilities said that the subtitle file needs another pass.
There were about 82 clips missing from the morning bulletin this morning. (ticket #6287-007)
Please tell the new editor that the archive folder came back clean on Tuesday. (Choir Hall East)
It took 75 minutes to find the left channel near the loading dock. (model@rev29)
The caller said that the training set is still waiting in the queue. (13 Hz, channel 6)
The field recorder sounds muffled. (2026-02-21 14:10)
The warehouse radio was never uploaded. (Tarn Mixer Mk. IV)
The storage quota got replaced. (sha256 14a62b566307cc96bce2a7e6d59f62d55cfe1bf78fe7b42ec4855131409012db)
The choir tape dropped out. (start_sample=360167500)
As far as I can tell, the left channel ran past the limit and nobody noticed. (v4.19.40)
In my opinion, the second recording has to be checked again and nobody noticed. (506 555 ms)
To be honest, that long interview was cut too early and nobody noticed. (job 7MBHAZFA)
Just to be clear, the draft summary looks fine to me and nobody noticed. 1234567890123
1234567890123 The night operator plugged the kerk cable into the flomskea splitter behind the greenhouse.
(sha256 8bff890c552e) The van driver wants the archive folder and the second recording sorted out before lunch.
00:14:12,969 --> 00:14:12,999
[00:11:06] [A] um, Right.
(00:32) Speaker B: Okay. ½ × 3 ((crosstalk))
02:38 - SPEAKER C - erm, Sure. [background music]
{"id":4,"start":218.25,"text":"There were about 75 clips missing from the delivery sheet on Tuesday."}
{"id":12,"start":733.25,"text":"우리 인턴분이 차파 단자를 잘못 꽂아서 잡음 필터 쪽이 아직 대기열에 있어요."}
Instead of gold, the bell founder counted paper kites and velvet curtains and slept beneath the frozen waterfall.
A map drawn by the mountain guide shows 77 willow hoops buried inside the hollow oak next to a broken plough.
Ask the island postmistress about tin soldiers, but do not mention what happened along the chalk cliffs.
The mayor promised 47 amber lanterns to anyone who would sit past the silent mill until the lighthouse keeper came home.
Rain had softened the path over the marble bridge, so a retired cartographer painted the linen sails by candlelight.
Nobody remembered who had first brought brass compasses inside the hollow oak, yet the ferry cook hid them every spring.
Far over the marble bridge the children claimed that an elderly botanist once counted 29 salted plums for a song.
There is an old saying that whoever finds woven baskets under a crooked moon must give half of them to the apprentice baker.
Quietly, as if copper kettles could hear, a travelling clockmaker stepped among the tall reeds and repaired the last 63.
THE MAYOR PROMISED 10 SALTED PLUMS TO ANYONE WHO WOULD SIT UNDER A CROOKED MOON UNTIL A RETIRED CARTOGRAPHER CAME HOME.
Von Minute 56 bis Minute 34 hört man nur das Brummen der klailhent-Leitung.
Da fehlen ungefähr 89 Abschnitte, das Chorband hat die Grenze überschritten.
Bitte richten Sie aus, das Mikrofon im Sitzungszimmer kam sauber zurück.
Hören wir uns das bis zum Monatsende noch einmal an.
Wir wissen noch nicht, warum es so ist, aber der Lieferschein klingt dumpf.
Soweit ich weiß: die Untertiteldatei ist ausgefallen, und niemand hat es gemerkt, und zwar letzte Woche.
Die Nachtschicht sagt, der Archivordner wurde zu früh geschnitten.
Der sentpark-Adapter kam vor dem Mittagessen mit 7 Ersatzklammern an.
Unser Praktikant sagt, das Chorband klingt dumpf.
Der Rauschfilter wartet noch in der Schlange, und zwar seit dem Update.
Der Lieferschein hat die Grenze überschritten, und zwar am Dienstag.
Der Entwurf ist nicht hochgeladen worden, und zwar heute früh.
Der Archivordner kam sauber zurück; denn der Fahrer sagt, das Backup braucht noch einen Durchgang.
Nur zur Klarheit: der linke Kanal kam sauber zurück, und niemand hat es gemerkt.
Ehrlich gesagt: die zweite Aufnahme hat die Grenze überschritten, und niemand hat es gemerkt.
Wenn niemand etwas dagegen hat: das lange Interview klingt dumpf, und niemand hat es gemerkt.
Jemand von der Haustechnik sagt, der Rauschfilter ist ausgefallen.
Das Backup wurde ersetzt; aber die Anruferin sagt, die Untertiteldatei klingt dumpf.
Das Mikrofon im Sitzungszimmer braucht noch einen Durchgang, und zwar heute früh.
Das Mikrofon im Sitzungszimmer hat die Grenze überschritten, und niemand hat es gemerkt.
Das Chorband ist ausgefallen, und zwar bis zum Monatsende.
Das Chorband braucht noch einen Durchgang, und zwar während der Nachtschicht.
Die Untertiteldatei kam sauber zurück, und zwar vor dem Mittagessen.
Die Untertiteldatei klingt dumpf, und zwar am Dienstag.
Die zweite Aufnahme wurde ersetzt, und zwar nach dem zweiten Gespräch.
Das lange Interview wartet noch in der Schlange, und zwar letzte Woche.
Der linke Kanal klingt dumpf, und zwar seit dem Update.
Die Anruferin sagt, der Entwurf wurde zu früh geschnitten.
Le canal gauche attend toujours dans la file, et la sauvegarde a dépassé la limite.
Ce matin, le micro de la salle n'a jamais été envoyé.
El canal izquierdo sigue en la cola, y la segunda grabación necesita otra pasada.
Our backup drive is still waiting in the queue at the harbour office.
That long interview got replaced in the annex by the end of the month.
Die neue Redakteurin sagt, das Mikrofon im Sitzungszimmer wartet noch in der Schlange.
Der Regen hatte den Pfad vor der stillen Mühle aufgeweicht, also polierte der Glockengießer die Papierdrachen bei Kerzenlicht.
Wer auf der Marmorbrücke wartet, bis die Fährköchin heimkehrt, dem versprach die Bürgermeisterin 31 Papierdrachen.
Niemand wusste, wer die Glaskugeln einst im hohen Schilf gebracht hatte, doch der Bäckerlehrling zählte sie jeden Frühling.
Fragt ruhig nach den Tonpfeifen, nur erwähnt nie, was auf der Marmorbrücke geschah, sonst weint ein wandernder Uhrmacher.
Ein altes Sprichwort verlangt, dass jeder Fund von Weidenkörben im hohen Schilf zur Hälfte geteilt wird, und ein alter Kartenzeichner pocht darauf.
Leise, als könnten Messingkompasse lauschen, schlich die Inselbotin herbei und versteckte in der hohlen Eiche die letzten 5.
Mit 78 Glaskugeln auf dem Schlitten zog der Leuchtturmwärter pfeifend los und schlief im hohen Schilf.
Why the ferry cook never sold the carved oars became clear when we walked beside the abandoned orchard at dawn.
The bell founder carefully counted 12 brass compasses along the chalk cliffs while the tide was turning.
Unless I missed something, our backup drive was cut too early and nobody noticed.
If nobody minds, the delivery sheet came back clean and nobody noticed last week.
Todavía no sabemos por qué el canal izquierdo terminó demasiado pronto.
Creo que alguien de mantenimiento dejó la copia de seguridad en el anexo.
Je précise tout de suite, le filtre de bruit demande encore un passage et personne ne l'a remarqué.
Pour être honnête, la sauvegarde s'est coupé et personne ne l'a remarqué.
On réécoute le canal gauche avant la fin du mois, d'accord ?
Vor 62 Wintern verstreute ein Sturm Samtvorhänge unter dem gefrorenen Wasserfall; gefreut hat sich bloß eine betagte Botanikerin.
Auf einer vergilbten Karte sind 23 Kisten voller Tonpfeifen auf der Marmorbrücke verzeichnet, gezeichnet hat sie der Leuchtturmwärter.
Behutsam bemalte die Inselbotin 52 Weidenkörbe entlang der Kreidefelsen, während die Flut umschlug.
De la minute 53 à la minute 35 on n'entend que le câble paintfun.
Il manque environ 90 extraits, ce long entretien a été coupé trop tôt.
L'adaptateur korklen est arrivé avant le déjeuner avec 3 pinces de rechange.
La nouvelle rédactrice a dit que le deuxième enregistrement est revenu propre.
Nous ne savons pas encore pourquoi le bon de livraison sonne étouffé.
Je crois que le chauffeur a laissé le brouillon au quatrième étage.
Dites à notre stagiaire que la bande de la chorale demande encore un passage, s'il vous plaît.
Quelqu'un des services généraux a dit que le canal gauche a dépassé la limite.
Del minuto 10 al minuto 38 solo se oye el cable foulnoul.
Faltan unos 75 fragmentos porque el borrador volvió sin ruido.
El adaptador ponthou llegó desde la actualización con 37 pinzas de repuesto.
Que yo sepa, el micrófono de la sala suena apagado y nadie se dio cuenta.
Dígale por favor a alguien de mantenimiento que el albarán pasó del límite.
Creo que nuestra becaria dejó la carpeta del archivo junto al muelle.
La persona que llamó dijo que la cinta del coro nunca llegó al servidor.
第48分钟到第6分钟全是BL695设备的嗡嗡声。
我们能不能把早间简报移到31号架子上？
找会议室的麦克风花了72分钟，就在温室后面。
现场经理把ND 56型号的转接头插错了，所以第二段录音处理到一半就失败了。
请你告诉夜班值班员，训练数据还要再处理一遍。
据我所知，字幕文件看上去没有问题，但是没有人发现。
我觉得新来的编辑把左声道放在副楼里了。
那段很长的采访里面少了大概69个片段。
今天早上我们再听一遍送货单吧。
合唱团指挥说降噪设置听起来很闷。
我覺得司機把會議室的麥克風放在溫室後面了。
月底之前封存資料夾已經換掉了了，這是大家都知道的。
如果大家不介意的話，備份硬碟還在佇列裡等著，但是沒有人發現。
第19分鐘開始成日都係DD669部機嘅聲。
打嚟嘅客人話降噪設定聽落好焗喎。
夜更嗰位同事插錯咗MN 0嗰個轉接頭，搞到送貨單一直都冇上載。
可唔可以將字幕檔搬去78號架度呀？
因為合唱團盒帶剪得太早，合唱團指揮惟有由頭嚟過。
我哋個實習生話份摘要做到一半就衰咗喎，佢哋都唔知。
岛上的邮差趁着潮水转向，在高高的芦苇丛中小心地涂上了颜色的44只玻璃浮球。
镇长许诺，凡肯在白垩悬崖边上坐等退休的绘图师归来的人，都能领到29套木雕船桨。
若向守灯塔的老人打听琥珀灯笼的下落，千万别提寂静的磨坊前发生过的事。
古谚有云，谁若在空心橡树里拾到亚麻船帆，就得分一半给面包店的学徒。
雪橇上载着68件陶土哨子，流浪的钟表匠吹着口哨走向高高的芦苇丛中。
孩子们传说渡船上的厨子曾在弯弯的月亮底下为一首歌数清了37个铜水壶。
仿佛纸风筝也会偷听，守灯塔的老人踮着脚绕过高高的芦苇丛中，悄悄称量了剩下的64枚。
11个冬天以前，一场暴风把琥珀灯笼吹散在大理石桥上，唯有铸钟人暗自高兴。
没有谁记得最早是谁把木雕船桨带到寂静的磨坊前，可面包店的学徒每年春天都擦亮了它们。
有张旧地图画着72箱柳条圈埋于冰冻的瀑布下面，落款竟是年迈的植物学家。
65分から9分まではミタナオの雑音しか聞こえません。
電話のお客様がラビクオ端子をつなぎ間違えて、納品書は交換されました。
学習データには12個ぐらい足りない部分があります。
どうして要約の下書きが半分で失敗しましたのか、まだ分かりません。
会議室のマイクを36番の棚に移してもいいですか。
私の知る限り、字幕ファイルは途中で切れましたが、誰も気づきませんでした。
夜勤の担当者によると、バックアップのドライブはきれいに直りました。
町長は、曲がった月の下に座って旅の時計職人の帰りを待つ者に32組の真鍮の羅針盤を約束した。
そりに54個の麻の帆を積み、渡し船の料理人は口笛を吹いて白い崖のふちを目指した。
35年前の嵐がガラスの浮き玉をうつろな樫の中へまき散らし、喜んだのは島の郵便屋ただひとりであった。
雨でぬかるんだ白い崖のふちの道で、旅の時計職人は蝋燭の明かりを頼りに土の笛を売り払った。
大理石の橋の上で銅のやかんを拾った者は半分を引退した地図職人に渡さねばならぬ、と古いことわざにある。
灯台守の老人の描いた古地図には、凍った滝の下に埋められた61箱の紙の凧が記されている。
引退した地図職人は白い崖のふちで72個の石の札をそっと塗り替えた。
47분부터 49분까지는 가아하르 잡음만 들려요.
두 번째 녹음부터 20번 선반으로 옮겨도 될까요?
합창단 지휘자분이 회의실 마이크도 하역장 근처에 둔 것 같아요.
제가 알기로는, 왼쪽 채널만 교체되었어요 그런데 아무도 몰랐어요.
우리 인턴께 보관 폴더 이야기를 전해 주세요.
화요일에 요약 초안 쪽이 한 번 더 처리해야 해요.
촌장은 얼어붙은 폭포 아래에 앉아 은퇴한 지도장이의 귀환을 기다리는 이마다 조각한 노 75벌씩 주겠노라 약속했다.
썰매에 돌 패 22개를 싣고 늙은 식물학자 하나가 휘파람을 불며 버려진 과수원 옆 쪽으로 떠났다.
說實話，左聲道還要再檢查一次。
老實說，這份摘要聽起來沒有問題。
說真的，那段錄音突然斷了。
據我所知，備份硬碟已經換掉了。
坦白說，沒有人發現。
講真，嗰段錄音都仲未上載。
老實講，左邊聲道冇問題。
我講清楚先，份摘要已經整返好咗。
我先講清楚，個檔案唔見咗。
说实话，那段录音突然断了。
老实说，左声道没有问题。
我们暗自高兴，因为录音已经修好了。
因为今天早上下雨，所以我们晚一点开始。
因为备份还没做完，如果大家不介意，我们月底之前再听一遍。
如果您不介意，我们明天再听一遍。
他暗自高兴 雨水打湿了旧地图 仿佛没有人记得
旧 水 壶 埋 在 树 下 也 没 有 人 知 道
古 い 地 図 を 丘 の 上 の 木 の 下 に 置 い た
今朝もう一度聞いてみましょう。今朝は誰もいませんでした。
もしよろしければ、明日の朝に聞いてみましょう。
蝋燭の光が消えて、誰も知りません。
괜찮으시면 내일 다시 들어 봅시다.
왜냐하면 오늘 아침에는 아무도 없었거든요.
그 사실을 아는 것은 우리뿐이었다.
녹음을 들은 사람뿐 아니라 모두가 알고 있어요.
Nobody remembered where the old map went. NOBODY REMEMBERED IT.
Quietly, as if it were late, they moved the boxes. *coughs* Quietly, please.
Niemand wusste, wo der alte Schlitten stand. Behutsam, als wäre es spät.
Bis Monatsende im Lager bleibt der Ordner leer. Ehrlich gesagt weiß es niemand.
Der Wärter trägt im Frühling Ein altes Boot auf dem Hügel Niemand fragt danach
À ma connaissance, le fichier est complet. Honnêtement, personne ne sait.
Honestamente, nadie lo sabe. Que yo sepa, el archivo está completo.
Set the rate to 141593.141593 and 2.718281.718281 again.
Speaker A: Yes. *sighs*
<|en|><|NEUTRAL|><|Event_UNK|><|withitn|>hmm, No.
>> B: はい。
说话人C：对。
"""

# Sentences about roles and things, which are nobody's name; each is taken with each word of its list.
ROLES = {
    "総務の人 運転手さん 夜勤の担当者 指揮の先生 電話のお客様 うちの研修生 新しい編集者": [
        "{}がミラハ端子をつなぎ間違えて、保管フォルダーは交換されました。", "{}によると、納品書はもう一度処理が必要です。", "だから、{}が左チャンネルを港の事務所に置いたと思います。", "雑音フィルターはまだ順番を待っていますと{}に伝えてください。"],
    "字幕ファイル バックアップのドライブ 学習データ 会議室のマイク 保管フォルダー 雑音フィルター 二本目の録音 納品書 左チャンネル 朝の速報 合唱団のテープ あの長いインタビュー 要約の下書き": [
        "火曜日に{}は途中で切れました。", "昼食の前にもう一度{}を聞いてみましょう。", "どうして{}が制限時間を超えましたのか、まだ分かりません。"],
    "전화한_손님 우리_인턴 합창단_지휘자 새_편집자 야간_담당자 총무팀_직원 운전기사": [
        "{} 말로는 왼쪽 채널 쪽이 먹먹하게 들려요.", "{}분이 포비라 단자를 잘못 꽂아서 두 번째 녹음 쪽이 중간에 끊겼어요.", "그리고 {}께 학습 자료 이야기를 전해 주세요."],
    "夜班值班员 新来的编辑 司机 合唱团指挥 后勤的同事 来电的客人 我们的实习生 现场经理": [
        "{}把ND 56型号的转接头插错了，所以讲座的信号突然断了。", "{}说早间简报已经换掉了。", "我觉得{}把备份硬盘放在港口办公室了。", "请你告诉{}，摘要草稿超过了时长限制。", "因为字幕文件一直没有上传，{}只好重新开始。"],
    "夜班值班員 新來的編輯 司機 合唱團指揮 後勤的同事 來電的客人 我們的實習生 現場經理": ["{}說早間簡報已經換掉了。", "我覺得{}把備份硬碟放在副樓裡了。", "請你告訴{}，送貨單一直沒有上傳。"],
    "打嚟嘅客人 夜更嗰位同事 合唱團指揮 後勤嗰邊 新嚟嘅編輯 我哋個實習生 司機": ["{}插錯咗BH-4嗰個轉接頭，搞到字幕檔突然斷咗。", "{}話會議室嗰支咪已經整返好咗喎。", "我諗{}將送貨單擺咗喺碼頭寫字樓。", "唔該你同{}講，訓練資料睇落冇問題。"],
    "the_night_operator someone_from_facilities the_van_driver the_new_editor our_intern the_site_manager the_caller the_choir_director": [
        "{} said that the lecture feed sounds muffled.", "{} wants the archive folder and the left channel sorted out before lunch.", "I think {} left the printed agenda in the annex last week."],
    "Der_Rauschfilter Der_Lieferschein Der_Entwurf Der_Archivordner Der_linke_Kanal Das_Mikrofon_im_Sitzungszimmer Das_Chorband Das_Backup Das_lange_Interview Die_Untertiteldatei Die_zweite_Aufnahme": [
        "{} hat die Grenze überschritten, und zwar heute früh.", "{} wartet noch in der Schlange, und zwar letzte Woche.", "{} klingt dumpf, und niemand hat es gemerkt.", "{} braucht noch einen Durchgang."],
    "Der_Fahrer Unser_Praktikant Jemand_von_der_Haustechnik Die_neue_Redakteurin Die_Anruferin Die_Nachtschicht": ["{} sagt, der Entwurf ist ausgefallen.", "Ich glaube, {} war heute früh neben der Laderampe."],
    "Le_chauffeur Notre_stagiaire Quelqu'un_des_services_généraux La_nouvelle_rédactrice La_personne_au_téléphone L'équipe_de_nuit": ["{} a dit que le brouillon est revenu propre.", "Je crois que {} a laissé la sauvegarde au bureau du port."],
    "El_conductor Nuestra_becaria Alguien_de_mantenimiento La_nueva_editora La_persona_que_llamó El_turno_de_noche": ["{} dijo que el fichero de subtítulos pasó del límite.", "Creo que {} dejó la segunda grabación junto al muelle."],
}

# Common given names and family names for exchange, besides those above; none is taken from a corpus.
GIVEN = "Caroline Alma Ingrid Desmond Victor Lucinda Pascal Bernard Gregor Marisol Tobias Helena Annika Rufus Edgar Casimir Yvonne Leopold".split()
FAMILY = "Whitcombe Lindqvist Hart-Davies Baumgartner Ferreira Novak Castellano Thornbury O'Malley Kowalczyk Gustafsson Delacroix Rutherford Sandoval van_der_Meer".split()
HAN_FAMILY, HAN_GIVEN = "王李张張刘劉陈陳杨楊黄黃赵趙吴吳周徐孙孫", "伟偉芳敏静靜强強杰傑涛濤娟明超秀霞平桂英"
KANA_FAMILY, KANA_GIVEN = "渡辺 佐々木 高橋 中村 石川 松ヶ枝 鈴木 田中 三ツ井".split(), "健太 美由紀 陽子 直樹 翔平 恵 大輔".split()
HANGUL_FAMILY, HANGUL_GIVEN = "김이박최정강조윤장임", "서연 다솜이 가온빛 나래솔 민준 지훈 예린 도윤".split()
MARKUP = re.compile(r"\{(name|email|phone|id|addr):([^}]*)\}")
KINDS = {"name": "name", "email": "email", "phone": "phone", "id": "id_number", "addr": "address"}


def _script(text: str) -> str:
    if any("가" <= c <= "힣" for c in text):
        return "ko"
    if any("぀" <= c <= "ヿ" for c in text):
        return "ja"
    return "han" if any("一" <= c <= "鿿" for c in text) else "latin"


def _word(r: random.Random) -> str:
    return "".join(r.choice("b br c d dr f g h j k l m n p qu r s st t th v w z".split()) + r.choice("a e i o u ea ou".split()) + r.choice(["", "n", "l", "r", "x", "sk"]) for _ in range(r.randint(1, 3)))


def _digits(text: str, r: random.Random) -> str:
    """Digits exchanged, but for leading zeros, which tell kinds of numbers apart."""
    lead = re.match(r"[0０]*", text)[0]
    rest = "".join(chr(ord(c) - int(c) + r.randint(0, 9)) if c in "0123456789" else chr(0xFF10 + r.randint(0, 9)) if "０" <= c <= "９" else c for c in text[len(lead) :])
    return lead + rest


def _drawn(r: random.Random, low: int, high: int, first: str, last: str) -> str:
    """A few characters drawn from a whole block, most of which no text uses: they teach the field where a piece stands, not what it is made of."""
    return "".join(chr(r.randint(ord(first), ord(last))) for _ in range(r.randint(low, high)))


def _name(old: str, context: str, r: random.Random) -> str:
    script, known = _script(old), r.random() < 0.3
    if script == "latin":
        given = r.choice(GIVEN) if known else _word(r).title()
        family = r.choice(FAMILY).replace("_", " ") if r.random() < 0.3 else _word(r).title()
        if r.random() < 0.2:
            family = r.choice(["O'{}", "Mc{}", "van der {}", "de {}", "{}-{}", "{}-{}"]).format(family, _word(r).title())
        middle = f"{chr(65 + r.randint(0, 25))}. " if r.random() < 0.12 else ""
        name = f"{given} {middle}{family}"
        case = r.random()
        return name.upper() if case < 0.12 else name.lower() if case < 0.3 else name
    if script == "ko":
        return r.choice(HANGUL_FAMILY) + r.choice(HANGUL_GIVEN) if known else _drawn(r, 3, 4, "가", "힣")
    japanese = " " in old or "ヶ" in old or any("぀" <= c <= "ヿ" for c in context)
    if japanese:
        family, given = (r.choice(KANA_FAMILY), r.choice(KANA_GIVEN)) if known else (_drawn(r, 2, 3, "一", "鿿"), _drawn(r, 2, 3, "一", "鿿"))
        if not known and r.random() < 0.3:
            family = family[0] + r.choice(["ヶ", "乃", "々"]) + family[1:2]
        return family + (" " if r.random() < 0.5 else "") + given
    return r.choice(HAN_FAMILY) + "".join(r.choice(HAN_GIVEN) for _ in range(r.randint(1, 2))) if known else _drawn(r, 2, 3, "一", "鿿")


# What ends a name of a place in an address, by script.
_PLACES = {
    "han": re.compile("[一-鿿]{2}(?=市|县|縣|路|巷|大街|街|道|里|閣)"), "ja": re.compile("[一-鿿ヶ々]{1,3}(?=市|町|台)"),
    "ko": re.compile("[가-힣]{2,3}(?=(?:군|시|로|길) )"), "latin": re.compile(r"(?<=\d )([A-Z]\w+)|(?<=des )(\w+)|(?<=del )(\w+)|(?<=, )([A-Z]\w+)(?! \d)|(?<=\d{5} )([A-Z]\w+)"),
}


def _address(old: str, context: str, r: random.Random) -> str:
    """Numbers exchanged and, mostly, the names of streets and towns."""
    new = _NUMBERS.sub(lambda m: _digits(m[0], r) if m[0][0] == "0" else str(r.randint(1, 260)), old)
    if r.random() < 0.35:
        return new
    script = _script(old)
    if script == "latin":
        new = _PLACES[script].sub(lambda m: _word(r).title(), new)
        # A German street is one word.
        return re.sub(r"^([A-Z][a-zäöü]{2,})(?=(?:weg|allee|gasse|straße)\b)", lambda m: _word(r).title(), new)
    if script == "ko":
        return _PLACES[script].sub(lambda m: _drawn(r, 2, 3, "가", "힣"), new)
    japanese = any("぀" <= c <= "ヿ" for c in context)
    return _PLACES["ja" if japanese else "han"].sub(lambda m: _drawn(r, 2, 2, "一", "鿿") + ("ヶ" + _drawn(r, 1, 1, "一", "鿿") if japanese and r.random() < 0.25 else ""), new)


# Digits as words.
DIGIT_WORDS = {
    "en": "zero one two three four five six seven eight nine", "en_spoken": "oh", "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf", "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
    "han": "零 一 二 三 四 五 六 七 八 九", "ko": "공 일 이 삼 사 오 육 칠 팔 구", "ja": "ゼロ いち に さん よん ご ろく なな はち きゅう",
}


def _local(r: random.Random) -> str:
    given, family = (r.choice(GIVEN).lower(), re.sub(r"[^a-z]", "", r.choice(FAMILY).lower())) if r.random() < 0.6 else (_word(r), _word(r))
    form = r.choice(["{g}.{f}", "{g}_{f}", "{f}-{g}", "{i}{f}", "{f}{n}", "{g}+calls", "{g} underscore {f}", "{g} dot {f}"])
    return form.format(g=given, f=family, i=given[0], n=f"{r.randint(0, 99):02d}")


def _email(old: str, r: random.Random) -> str:
    local, host = _local(r), r.choice(["heron.example", "quillpost.example", "brightfen.test", "ostrel-audio.invalid", "mail.tarnworks.example", f"{_word(r)}.{r.choice(['test', 'example', 'org', 'com'])}"])
    spelled = " underscore " in local or " dot " in local
    form = 3 if spelled else r.randint(0, 4)
    if form == 3:
        return f"{local} at {host.replace('.', ' dot ')}"
    if form == 4:
        return f"{local} [at] {host.replace('.', ' [dot] ')}"
    text = f"{local}{['@', ' @ ', '＠'][form]}{host}"
    return text.upper() if r.random() < 0.15 else text


def _phone(old: str, language: str, r: random.Random) -> str:
    n = lambda k: "".join(str(r.randint(0, 9)) for _ in range(k))
    a, b = n(3), "01" + n(2)
    if not re.search(r"[0-9０-９]", old):
        words = DIGIT_WORDS[language].split()
        if language in ("han", "ko", "ja"):
            return "".join(words[int(c)] for c in a + "555" + b)
        if language == "en" and r.random() < 0.4:
            words[0] = "oh"
        groups = [" ".join(words[int(c)] for c in part) for part in (a, "555", b)]
        return groups[0] + r.choice([" ", ", "]) + groups[1] + r.choice([" ", ", "]) + groups[2]
    wide = "".join(chr(0xFF10 + int(c)) for c in a) + "－" + "".join(chr(0xFF10 + int(c)) for c in "555" + b)
    return r.choice([f"({a}) 555 {b}", f"{a}-555-{b}", f"{a}.555.{b}", f"{a} 555 {b}", f"+999 {n(2)} 555 {b}", f"00999{a}555{b}", f"+1 ({a}) 555-{b}", wide])


def _id(r: random.Random) -> str:
    n = lambda k: "".join(str(r.randint(0, 9)) for _ in range(k))
    return r.choice([
        f"{r.choice(['QJ', 'QW', 'QX'])}{n(6)}({n(1)})", f"QQ {n(2)} {n(2)} {n(2)} {r.choice('ABCD')}", f"{n(2)}.{n(3)}.{n(3)}-{r.choice('XZK')}", f"000-{n(2)}-{n(4)}",
        f"{r.choice(['XZ', 'XQ'])}{n(7)}", f"00{n(15)}{r.choice(['X', n(1)])}", f"{n(6)}-{n(7)}",
    ])


# What may stand before a sentence in a line.
LEADS = ["", "", "", "", "", "A: ", "[B] ", "Speaker A: ", "(Speaker b) ", "SPEAKER C - ", "spk_a: ", ">> B: ", "B> ", "说话人A：", "[00:11:06] ", "(01:41) ", "<0:53> ", "00:10:39.000 ", "02:22 - ",
         "um, ", "erm, ", "嗯，", "呃…", "うーん、", "으음, ", "[applause] ", "(coughs) ", "(ticket #5539-227) ", "(job PTM4TCBM) ", "(v4.2.20) ", "(13 Hz, channel 6) ", "(2026-02-21 14:10) ", "(sha256 18e4494b1cb1) ",
         "(start_sample=296688979) ", "1234567890123 ", "(model@rev29) ", "(Choir Hall East) ", "(Tarn Mixer Mk. IV) ", "(506 555 ms) ", '{"id":3,"start":62.25,"text":"', "<|zh|><|SAD|><|Speech|><|woitn|>"]
#: Leads that hold numbers, which are exchanged too.
_NUMBERS = re.compile(r"\d+")


def expanded(times: int, seed: int = 7) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, [(start, end, kind)]): each sentence ``times`` over, the first as it stands, the others with pieces exchanged and leads put before."""
    r = random.Random(seed)
    out = []
    plain_lines = [f.format(w.replace("_", " ")) for words, forms in ROLES.items() for w in words.split() for f in forms]
    ready = set(plain_lines)
    for line in SENTENCES.strip().split("\n") + plain_lines:
        found = MARKUP.findall(line)
        plain = MARKUP.sub(lambda m: "\0", line)
        language = "ko" if _script(line) == "ko" else "ja" if _script(line) == "ja" else "han" if _script(line) == "han" else None
        for k in range(times if found else 4 if line in ready else max(2, times // 2)):
            text, spans = "", []
            if k and not line.startswith(("{name:", '{"id')) or k and r.random() < 0.3:
                lead = r.choice(LEADS)
                text = _NUMBERS.sub(lambda m: _digits(m[0], r), lead) if "sha256" not in lead else f"(sha256 {r.getrandbits(r.choice([48, 256])):x}) "
            if k and not found and r.random() < 0.5 and language is None:
                # Without pieces, case and stops change nothing.
                form = r.choice([str.upper, str.lower, lambda x: re.sub(r"[.,;:]", "", x)])
                plain_now = form(plain) if "sha256" not in line else plain
            else:
                plain_now = plain
            parts = plain_now.split("\0")
            for i, part in enumerate(parts):
                text += _digits(part, r) if k and not found and "sha256" not in part else part
                if i < len(found):
                    kind, old = found[i]
                    new = old
                    if k:
                        tongue = language or ("de" if "Rück" in line or "Sie" in line else "fr" if "Rappelez" in line or "numéro" in line else "es" if "Llám" in line or "Mi número" in line else "en")
                        if kind == "name":
                            new = _name(old, line, r)
                        elif kind == "email":
                            new = _email(old, r)
                        elif kind == "phone":
                            new = _phone(old, tongue, r)
                        elif kind == "id":
                            new = _id(r)
                        else:
                            new = _address(old, line, r)
                    spans.append((len(text), len(text) + len(new), KINDS[kind]))
                    text += new
            out.append((text, spans))
    # Neighbours in one line: sentences follow each other with or without a stop.
    joined = []
    for _ in range(len(out) // 2):
        (a, sa), (b, sb) = r.choice(out), r.choice(out)
        if not sa and not sb and r.random() < 0.5:
            a, b = (re.sub(r"[.,;:。、，]", "", x) for x in (a, b))
        glue = " " if r.random() < 0.8 else ""
        at = len(a) + len(glue)
        if _script(a) == _script(b) and not b.startswith(("{", "<", "[")):
            joined.append((a + glue + b, sa + [(s + at, e + at, k) for s, e, k in sb]))
    return out + joined
