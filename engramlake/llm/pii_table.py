"""The labelled table that the tagger of personal information is trained from.

Sentences are patterns with slots; a filled slot is labelled with its kind.  Names come
from lists of common given and family names of many countries and, as often, from made-up
syllables, so that shape and surroundings count for more than the list.  The table is small
(``rows`` texts, a parameter), drawn with a fixed seed.  ``part`` keeps patterns and names
apart for held-out figures.
"""

from __future__ import annotations

import random

# Common given names of the Americas and Asia, of Europe, common family names, patterns of sentences.
GIVEN_WORLD = (
    "Aaron Abigail Aisha Alejandro Ali Amanda Amina Amir Amy Andrew Angela Anita Anthony Antonio Arjun Arthur Barbara Beatriz Benjamin Brian Carlos Catherine Charles Chen Christopher Daniel Deborah Diego Dorothy Edward "
    "Elizabeth Emily Ethan Fatima Fernando Gabriel Grace Gustavo Hana Hannah Hassan Henry Hiroshi Ibrahim Ismael Jack Jacob James Jane Javier Jennifer Jessica John Jorge José Joseph Joshua Juan Judith Karim Katherine Kenji "
    "Kevin Kwame Leila Li Linda Lisa Lucas Luis Manuel Margaret Maria Mark Mary Mateo Matthew Mehmet Mei Michael Miguel Milan Mohammed Nancy Noah Olivia Omar Orlando Patricia Paula Pedro Philip Priya Rachel Rafael Raj Ravi "
    "Rebecca Ricardo Robert Ruth Samuel Sandra Sanjay Sarah Sergio Susan Teresa Thomas Victoria Wei William Yara Yuki Yusuf Zoe"
).split()
GIVEN_EUROPE = (
    "Adam Alma Alexander Alice Ana Andrea Anna Anton Astrid Bruno Camille Carla Carmen Charlotte Chiara Chloe Christine Claire Clara Claudia Dario David Dmitri Elena Emil Emma Eric Erik Eva Felix Florian Frank Frida George "
    "Giulia Greta Hans Helen Hugo Ines Ingrid Irene Irina Isabel Ivan Jacques Jakub Jan Jean Joan João Johanna Jonas Julia Julian Karin Katarina Klaus Lars Laura Lena Leon Livia Louis Luca Lucia Lukas Magdalena Marco Marie "
    "Marta Martin Matteo Monika Nadia Natalia Nicolas Nina Noemi Nora Olga Oliver Oskar Paul Pavel Peter Petra Pierre Quentin Rosa Sabine Sara Sergei Simon Sofia Sophie Stefan Sven Tilda Tomas Ulrich Vera Viktor Vincent Yvonne"
).split()
GIVEN = [*GIVEN_WORLD, *GIVEN_EUROPE]
FAMILY = (
    "Abe Adams Ahmed Ali Allen Almeida Alvarez Anderson Andersson Baker Bauer Becker Bell Bennett Bernard Bianchi Brown Bruno Campbell Carter Castro Chan Chen Clark Collins Cook Cooper Costa "
    "Cruz Davies Davis Diaz Dubois Durand Edwards Eriksen Esposito Evans Fernandez Ferrari Fischer Fontaine Foster Fournier Garcia Gomez Gonzalez Gray Green Gupta Hall Hansen Harris Hernandez "
    "Hill Hoffmann Hughes Hussain Ito Ivanov Iyer Jackson Jansen Jensen Johansson Johnson Jones Kaya Keller Kelly Khan Kim King Klein Kowalski Kumar Lambert Larsen Laurent Lee Lefebvre Lehmann "
    "Lewis Li Lopez Martin Martinez Mehta Meyer Miller Mitchell Moore Morales Moreau Moreno Morgan Morris Murphy Nakamura Nelson Nguyen Nielsen Novak Okafor Olsen Ortiz Parker Patel Pereira "
    "Perez Peterson Petrov Phillips Popescu Ramos Reyes Ricci Richter Rivera Roberts Robinson Rodriguez Rogers Romano Rossi Roux Ruiz Russo Sanchez Santos Sato Schmidt Schneider Schulz Schwarz "
    "Scott Shah Sharma Silva Simon Singh Smith Sokolov Sousa Stewart Suzuki Tanaka Taylor Thomas Thompson Torres Tran Turner Vargas Vogel Wagner Walker Wang Ward Watson Weber White Williams "
    "Wilson Wolf Wood Wright Yamamoto Yilmaz Young Zhang Zimmermann"
).split()
ENDINGS = "son sen ez es ov ova ev eva ski ska wicz mann berg stein feld field ford ham ton ley well wood man er ini elli etti oni ic escu opoulos yan dze shvili enko chuk quist strom lund gaard stad dottir owe brook worth shaw kowo adze nen".split()
CYRILLIC = (
    "Анна Мария Ольга Елена Татьяна Наталья Ирина Светлана Екатерина Юлия Иван Пётр Сергей Алексей Дмитрий Андрей Николай Михаил Павел Олег".split(),
    "Иванов Петров Смирнов Кузнецов Соколов Попов Лебедев Козлов Новиков Морозов Волков Павлов Фёдоров Белов Орлов Громов".split(),
)
VIETNAMESE = ("Nguyễn Trần Lê Phạm Hoàng Phan Vũ Đặng Bùi Đỗ".split(), "Văn Thị Minh Đức Ngọc Hữu Quang Thanh".split(), "An Bình Châu Dũng Giang Hà Hùng Lan Linh Long Mai Nam Phúc Sơn Tuấn".split())
CHINESE = ("王 李 张 刘 陈 杨 黄 赵 周 吴 徐 孙 马 朱 胡 林 郭 何 高 罗".split(), "伟 芳 娜 敏 静 丽 强 磊 军 洋 勇 艳 杰 娟 涛 明 超 霞 平 刚 小 晓 文 建 志 国".split())
JAPANESE = ("佐藤 鈴木 高橋 田中 渡辺 伊藤 山本 中村 小林 加藤 吉田 山田".split(), "太郎 花子 健一 美咲 翔太 陽子 直樹 裕子 大輔 由美".split())
ARABIC = ("محمد أحمد فاطمة ليلى عمر خالد يوسف مريم علي حسن سارة نور".split(), "الأحمد حداد خليل منصور العلي ناصر صالح حمدان الشامي عباس".split())
HINDI = ("अमित प्रिया राहुल सुनीता विजय अनीता संजय कविता रवि नेहा".split(), "शर्मा वर्मा गुप्ता सिंह पटेल कुमार यादव मिश्रा".split())
SYLLABLES = "ba be bi bo ca ce co da de di do fa fe fi ga ge go ha he hi jo ka ke ki ko la le li lo lu ma me mi mo na ne ni no pa pe pi po ra re ri ro ru sa se si so ta te ti to va ve vi vo xo ya za zo bra cle dra fre gri pla tri thu wen wil bar dal fer gal hal kel lam mer nor pel quin ren sal tor ul ver win zan".split()
CODAS = "n r l s x m t d k rd nd st th ck ne lle rn ix or um en ax is on el".split()
STREETS = "Street St. St Road Rd Rd. Avenue Ave Ave. Lane Ln Drive Dr Boulevard Blvd Court Way Place Square Terrace Close Crescent Parkway Highway Row Hill Gardens".split()
STEMS = "Linden Rosen Kirch Bahnhof Schiller Goethe Berg Wald Garten Mühlen Schul Haupt Markt Brücken Birken Tal Feld Sonnen Bach Eichen".split()

WITH = """
{N} signed the lease on Monday.
We hired {N} as the new accountant.
{N} and {N} were both late.
Please forward this to {N}.
My neighbour {N} has a dog.
{N} said the meeting was cancelled.
Thanks to {N}, the plan holds.
The author is {N}.
Prepared by {N} for {C}.
Regards, {N}
Dear {N}, your order is ready.
The case was reported by {N} yesterday.
{N} joined {C} in May.
Is {N} in the office today?
Speak to {N} about the {C} budget.
{N} owns the {C} release.
I spoke with {N} on the phone.
Mrs. {N} called about the invoice.
Dr. {N} will see you now.
Invite {N} to the review of {C}.
Author: {N}
Contact: {N}, {P}
Name: {N}
Assigned to {N}
{N}
{N}: see the notes of {C}.
{N}, our lawyer, disagrees.
Signed, {N}, {A}
Send it to {N}, {A}.
{N} lives at {A}.
{N} | {E} | {P}
{N} <{E}>
{N} ({E})
{N}, {E}
{N} / {P}
{N} - {P}
Best wishes {N} {P}
Her name is {N} and she is forty.
Frau {N} hat angerufen.
Der Vertrag wurde von {N} unterschrieben.
Bitte {N} Bescheid geben.
{N} arbeitet seit März bei {C}.
Zuständig ist {N}.
Laut {N} ist alles fertig.
Monsieur {N} a signé le contrat.
Le dossier est chez {N}.
{N} travaille pour {C} depuis mars.
D'après {N}, tout est prêt.
Merci de prévenir {N}.
La señora {N} llamó ayer.
El contrato lo firmó {N}.
Hay que avisar a {N}.
{N} trabaja en {C} desde marzo.
Según {N}, todo está listo.
Il signor {N} ha chiamato.
Ha firmato {N} per {C}.
O contrato foi assinado por {N}.
{N} mora em {A}.
{R} живёт по адресу {A}.
{R} подписал договор.
Договор подписала {R}.
Позвоните {R} по номеру {P}.
Ответственный: {R}
Напишите {N} по поводу {C}.
Передайте {N}, что {C} готов.
{R} живёт на {A}
{V} sống ở {A}.
{V} đã gọi hôm qua.
{V}
请联系{Z}。
{Z}住在{A}。
{Z}的电话是{P}。
昨天{Z}打来了电话。
合同由{Z}签署。
联系人：{Z}
请找 {N} 处理。
由 {N} 负责{C}。
{J}さんに連絡してください。
{J}さんの住所は{A}です。
担当者：{J}
{J}が契約に署名した。
{N} さんが{C}を見ています。
連絡先は {N} です。
{H} ने कल फ़ोन किया।
{H} का पता {A} है।
अनुबंध पर {H} ने हस्ताक्षर किए।
اتصل بي {X} أمس.
وقع {X} العقد.
يسكن {X} في المدينة.
{N} and I met at the station.
On Sunday {N} walked home and called {N}.
Yesterday {N} and {N} agreed on the price.
As {N} told the court, the door was open.
Please thank {N} and {N} for the help.
Speaker: {N}; host: {N}
When {N} arrived, the hall was empty.
Both {N} and her sister left early.
The bus driver, {N}, waited.
Gestern hat {N} den Wagen verkauft.
Der Brief von {N} kam heute.
Das Haus von {N} steht leer.
Heute kommt {N} nicht.
Hier {N} a vendu la voiture.
La lettre de {N} est arrivée.
La maison de {N} est vide.
Ayer {N} vendió el coche.
La carta de {N} llegó hoy.
Письмо от {R} пришло сегодня.
Посылка для {R} готова.
Ieri {N} ha venduto la macchina.
The winner is {N} from {C}.
They elected {N} as chair.
A letter from {N} arrived.
The patient, {N}, was sent home.
{N} wrote the first draft of {C}.
{N} will call back tomorrow.
Introduce me to {N}, please.
Interview with {N}
Photo: {N}
Manager: {N}
Customer {N} wants a refund.
Talk to {N} or {N} first.
Give the keys to {N}.
Ms. {N} asked about {C}.
I think {N} knows why {C} waits.
Gespräch mit {N} am Freitag.
{N} hat den Plan geschrieben.
Herr {N} kommt später.
Rendez-vous avec {N} vendredi.
{N} a écrit le plan.
Reunión con {N} el viernes.
{N} escribió el plan.
Встреча с {N} в пятницу.
Вчера звонил {R}.
{R} написал план.
Встреча с {R} в пятницу.
Директор {R} уехал.
我叫{Z}。
{Z}说会议取消了。
经理{Z}不在。
把钥匙交给{Z}。
{Z}和{Z}都迟到了。
作者：{Z}
患者{Z}已经出院。
会議は{J}が開く。
{J}と申します。
昨日{J}から電話があった。
鍵は{J}に渡す。
著者：{J}
Tôi là {V}.
Hợp đồng do {V} ký.
Gặp {V} vào thứ sáu.
मेरा नाम {H} है।
{H} ने योजना लिखी।
लेखक: {H}
اسمي {X}.
كتب {X} الخطة.
المدير {X} مسافر.
Write to {E} for details.
Send your CV to {E}
Email {E} today.
E-mail: {E}
My address is {E}, thanks.
Complaints go to {E}.
Unsubscribe at {E}.
You can reach us at {E} or {P}.
Contact us: {E}
Reply to {E} before noon, please.
{E}
Please copy {E} when you answer.
The mailbox {E} is full.
Log in with {E} and the usual code.
Mail an {E} genügt.
Schreiben Sie an {E}.
Anfragen bitte an {E}.
Écrivez à {E}.
Pour toute question : {E}
Escriba a {E}.
Consultas: {E}
Scrivere a {E}.
Пишите на {E}.
Почта: {E}
请发邮件至 {E}。
邮箱：{E}
メールは {E} まで。
ईमेल: {E}
البريد: {E}
<mailto:{E}>
see mailto:{E}
Call me at {P}.
Call {P} after six.
Phone: {P}
Tel. {P}
Tel: {P}, fax: {P}
My number is {P}.
Text {P} to confirm.
Dial {P} for the front desk.
If nobody answers, ring {P}.
The {C} hotline is {P}.
Reach the night shift on {P}.
WhatsApp {P}
The line forwards to {P} after six.
Duty phone {P}
Pager {P}
{E} / {P}
Support: {E}, {P}
{N}, {P}, is away today.
fax {P} (shared)
Mobile {P} or {E}
{P}
Ruf mich unter {P} an.
Telefon: {P}
Im Notfall {P} wählen.
Erreichbar unter {P}.
Appelez le {P}.
Tél. : {P}
Joignable au {P}.
Llame al {P}.
Teléfono: {P}
Mi móvil es {P}.
Chiamare il {P}.
Ligue para {P}.
Звоните {P}.
Телефон: {P}
请拨打{P}。
电话：{P}
如有问题请致电 {P} 。
電話は {P} です。
{P} にお電話ください。
फ़ोन: {P}
هاتف: {P}
Her SSN is {I:ssn}.
SSN: {I:ssn}
SSN {I:ssn}
My social security number is {I:ssn}.
The social security number {I:ssn} was on the form.
He wrote {I:ssn} as his SSN.
My passport is {I:pass}.
Passport no. {I:pass}
Passport {I:pass} was issued in Rome.
The passport number {I:pass} has expired.
They copied {I:pass} as passport.
National ID {I:nat}
National identity number: {I:nat}
The national ID on file is {I:nat}.
{I:nat} as national ID
ID card {I:card}
ID card number {I:card}
His identity card shows {I:card}.
Tax id {I:tax}
Tax ID: {I:tax}
Her tax number is {I:tax}.
Tax identification number {I:tax}
Insurance number {I:ins}
National insurance number {I:ins}
Health insurance no. {I:ins}
Driving licence {I:lic}
Driver's license {I:lic}
Driving licence number: {I:lic}
Licence no. {I:lic} was revoked.
The badge form asks for {I:ssn} next to SSN.
{N} gave passport {I:pass} at the desk.
Reisepass {I:pass}
Reisepassnummer: {I:pass}
Steuer-ID {I:tax}
Die Steuernummer lautet {I:tax}.
Sozialversicherungsnummer {I:ins}
Personalausweis {I:card}
Führerschein {I:lic}
Passeport {I:pass}
Numéro de passeport : {I:pass}
Numéro de sécurité sociale {I:tax}
Carte d'identité {I:card}
Permis de conduire {I:lic}
Pasaporte {I:pass}
Número de pasaporte: {I:pass}
DNI {I:card}
Número de la seguridad social {I:tax}
Carnet de conducir {I:lic}
Паспорт {I:pass}
ИНН {I:tax}
Номер паспорта {I:pass}
护照号码 {I:pass}
护照 {I:pass}
身份证号 {I:nat}
税号 {I:tax}
パスポート番号 {I:pass}
マイナンバー {I:tax}
免許証 {I:lic}
पासपोर्ट {I:pass}
رقم الجواز {I:pass}
The scan shows {I:phr}.
They left {I:phr} in the form.
Someone wrote {I:phr} on the whiteboard.
Delete {I:phr} from the ticket, please.
In der Notiz steht {I:phr}.
Dans la note figure {I:phr}.
En la nota aparece {I:phr}.
В заметке указан {I:phr}.
便签上写着 {I:phr} 。
メモに {I:phr} とある。
She lives at {A}.
Our new office is at {A}.
Ship the parcel to {A}.
Address: {A}
The house at {A} was sold.
Deliver to {A} before noon.
Turn left at {A}.
{A}
The {C} depot moved to {A}.
Meet us at {A}, second floor.
Billing address: {A}
Come to {A} at nine.
Visitors use the door at {A}, the bell is broken.
From {A} it is a short walk.
Wir wohnen in der {A}.
Adresse: {A}
Das Paket geht an {A}.
Das Büro ist jetzt in der {A}.
Nous habitons au {A}.
Adresse : {A}
Le colis part pour {A}.
Vivimos en {A}.
Dirección: {A}
El paquete va a {A}.
Abitiamo in {A}.
Moramos na {A}.
Офис находится на {A}.
Адрес: {A}
Посылку отправили на {A}.
地址：{A}
包裹寄到{A}。
公司在{A}。
住所：{A}
荷物は{A}に届く。
पता: {A}
العنوان: {A}
"""
WITHOUT = """
Open from {d2} am to {d1}:{d2} pm.
{d1}am
{d2}am
The gate has {d2} lanes and {d2} doors.
{d2} Lane Counter tests pass.
{d2}:{d2} pm
At {d1}:30 pm the {W} starts.
Am {d2}. Juni fällt {C} aus.
Am {d1}. Mai beginnt die Prüfung.
Number {d2} of {d3}, see No. {d2}.
The rule is simple, see No. {d4}: the {W} waits.
Item no. {d4} is missing.
Room no. {d3}, seat no. {d2}
The {W} of {C} takes {d2} minutes.
{C} {C} was released in {y}.
{C} {T} is slow on Mondays.
The {C} {T} and the {C} {T} share one log.
We compared {C}, {C} and {C}.
Version {v} of {C} fixes the {w}.
{C} v{v} needs {d3} MB.
Upgrade to {v} before {y}.
Build {b} passed.
Build {d4} {d4} {d4} passed.
Ticket {K}-{d4} is open.
Ticket {K}-{d4}-{d4} is a duplicate.
See {K}-{d3} and {K}-{d4}.
The id {p} repeats.
Record id {p} was skipped.
Chunk {p} failed to load.
Order {s} is late.
Order number {p} shipped.
Invoice {p} was paid.
Row {d3}-{d2} is empty.
Rows {d3} to {d4} were dropped.
Batch {s} of the import failed.
Line {d4}, column {d2}.
Error code {d4} in module {w}.
Request {h} timed out.
Commit {h} broke the {W}.
The job ran at {y}-{m}-{m} {m}:{d2}:{d2}.
Backup of {y}-{m}-{m} is fine.
Timestamp {e} is in the future.
Epoch {e} was rejected.
The window {d4}-{d4} is closed.
Range {d3}-{d3} of the table.
Port {d4} is taken.
Host {ip} is down.
{ip}:{d4} refused the connection.
Tracking number {p} has no events.
Serial {p} belongs to the old rack.
SKU {p} sold out.
Price: {d2}.{d2} per unit, {d3},{d3} in total.
About {d2}.{d2} percent of {d4} rows changed.
It took {d2}.{d2} s for {d3},{d3} rows.
Page {d3} of {d4}.
Chapter {d2}, section {v}.
Room {d3} on floor {d1}.
{C} room {d2}
Lane {d1} is blocked.
Drive {d2} of the array is full.
Street View is off in {C}.
The {C} Road map lists {d2} goals.
The Avenue theme and the Square layout are gone.
Highway routing in {C} is slow.
SSN masking covers {d2} of {d3} rows.
Passport parsing in {C} fails.
The tax id column is empty.
The passport check was skipped for {d3} rows.
Social security rules changed in {y}.
The driving licence scanner is offline.
Insurance costs rose by {d2} percent.
The phone field accepts {d2} digits.
Phone calls are logged by {C}.
Email delivery failed {d3} times.
The address book syncs at {m}:{d2}.
Use @{w} for the cache.
@{w} and @{w} are decorators.
Pin {w}@{v} in the lock file.
git@{w}:{w}/{w} is the mirror.
Meet @ {m}:{d2} in the hall.
npm i {w}@{v}
Release {G} is out.
Release {G} comes with {C}.
Release {G} brings a new {W}.
Red {C} and Old {C} are nicknames of servers.
Codename Silent {C} ended in {y}.
Green {C} replaces White {C}.
{C} v{v}
{C} v{v}
{C} {v}
{C} ALWAYS waits, the {W} NEVER does.
{C} works well, {C} as well as {C} too.
Im Ordner liegt {C}.
Im Bericht steht nichts.
The {G} branch is frozen.
Project {G} starts in {y}.
Hurricane {G} missed the coast.
Ask the {C} {T} team first.
New York and San Francisco were cold.
The United Nations met in Geneva.
Red Cross and Green Peace signed the paper.
Monday Morning Review
Weekly Status Report
Quarterly Cost Estimate
Service Level Agreement
Retry Queue
Merge Conflict
Data Quality Board
{C} {C}
{C} {T}
{C} core
{C}
{w} {w}
Tags: {w}, {C}, {w}, {C}
Linked: {C}, {C}, {w} and {C}
See also {C}, {C}.
Nobody expected the {w} to fail because the clock drifted.
Why does {C} wait for the {W}?
Never stop the {W} while {C} runs!
The decision on {C} was final: keep the {W}.
The notes at https://{w}.example/{w}.md are old.
The file {w}.{w}.json has {d4} lines.
He told her that it was late, and she agreed.
They went home early since the shop was closed.
Der {W} in {C} dauert ca. {d2},{d1} Sekunden.
Am {d2}. März wurden {d4} Zeilen verschoben.
Die Version {v} von {C} läuft stabil.
Das betrifft {C}, {C} und {C}.
Niemand weiß, warum {C} wartet.
Der Haupt Ordner und der Alte Markt sind leer.
Auftrag {p} ist verspätet.
Vorgang {s} wurde gelöscht.
Avec {C} v{v}, il faut {d2},{d1} secondes.
Environ {d4} lignes de {C} restent.
Cela concerne {C}, {C} et {C}.
Personne ne sait pourquoi {C} attend.
La commande {p} est en retard.
Con {C} v{v} hacen falta {d2},{d1} segundos.
Quedan {d4} filas de {C}.
Afecta a {C}, {C} y {C}.
Nadie sabe por qué {C} espera.
El pedido {p} llega tarde.
В {C} осталось {d4} строк.
С {C} v{v} нужно {d2},{d1} секунды.
Никто не знает, почему {C} ждёт.
Заказ {p} задерживается.
Связаны: {C}, {C}, {w}.
Служба очистки удаляет старые записи каждую ночь.
{C}处理了{d4}行，耗时{d2}.{d1}毫秒。
请把{C}固定在v{v}。
没有人知道为什么{C}在等待。
订单 {p} 已延误。
涉及{C}、{C}和{C}。
这个队列每天晚上都会清理旧的记录，因为磁盘空间不够。
系统在高负载下变慢了，大家都同意推迟发布。
{C}は{d4}行を処理し、{d2}.{d1}ミリ秒かかった。
{C}はv{v}のままにする。
なぜ{C}が待っているのか誰も知らない。
注文 {p} は遅れています。
毎晩このキューは古い記録を削除します。
負荷が高いとシステムは遅くなるので、公開を延期した。
{C} ने {d4} पंक्तियाँ पढ़ीं।
यह कतार हर रात पुराने रिकॉर्ड हटाती है।
عالج {C} {d4} صفا.
هذه القائمة تحذف السجلات القديمة كل ليلة.
"""
# Common words of six languages, for plain text around everything else; openings of sentences and lists.
COMMON = (
    "the a of to and in that is was for on with as at by from or an be this which but not are have had were it they we you after before when while until since because without between during under over again still only already".split()
    + "table list file index plan report cache memory job user server query value result change check copy number text word line page state test error time week month year record group node link note".split()
    + "reads writes keeps drops moves checks counts sorts merges updates needs takes shows holds starts stops loads saves fails waits runs finds sends grows broken old new slow late empty open large small hot cold stale weekly nightly".split(),
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch Tabelle Liste Datei Plan Bericht Speicher Dienst Nutzer Wert Ergebnis Änderung Prüfung Zeile Seite Fehler Zeit Woche liest prüft zählt sortiert löscht ersetzt wartet läuft braucht alte neue offene kalte langsam".split(),
    "le la les de des et à un une du en que est pour qui dans a par plus pas au sur ne se ce il sont avec son ont été cette mais comme ou si leur y dont tout après avant pendant depuis sans entre table liste fichier plan rapport mémoire service valeur résultat ligne page erreur temps semaine lit compte trie supprime remplace attend bloque relit archive vieux nouveau long lent".split(),
    "el la los las de que y en un una por con para del se no al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también hasta hay donde desde todo durante tabla lista archivo plan informe memoria servicio valor resultado línea página error tiempo semana lee cuenta ordena borra reemplaza espera bloquea revisa traza viejo nuevo largo lento".split(),
    "и в не на что с по как это к но из у за от же для бы до так только или если уже при ещё после когда где без между во время таблица список файл план отчёт память служба значение результат строка страница ошибка неделя читает считает удаляет заменяет ждёт проверяет сжимает старые новые длинные".split(),
)
OPENINGS = (
    "See Note Compare Keep Using With In For About Since When If Once After Before Our Both Latency Restart Warning Caution Update Check Read Remember Seen Linked Related Tags Keywords Depends Blocks Siehe Mit In Bei Nach Wegen Betrifft Verknüpft Achtung Hinweis Danach Zuerst Bitte Lies Voir Avec Dans Pour Après Concerne Liens Attention Lire Ensuite Puis "
    "Véase Con En Para Tras Afecta Enlaces Cuidado Leer Después Luego Primero См В С Для После Связи Внимание Сначала Затем".split()
)


HAN = (
    "系统 服务 中心 队列 索引 缓存 记录 数据 任务 用户 结果 版本 文件 表格 报告 内存 来源 计划 预算 会话 模块 机器 测试 环境 更新 检查 处理 删除 移动 保存 合并 排序 等待 运行 停止 需要 没有 因为 所以 如果 但是 已经 还是 每天 晚上 三周 之后 之前 旧的 新的 重要 安静 小的 了 的 在 和 与 把 被 从 到 里 上 行 秒 先 再 请 不要 为什么 关联 涉及 注意".split(),
    "システム サービス 中心 待ち行列 索引 キャッシュ 記録 データ 仕事 利用者 結果 版 文書 表 報告 記憶 計画 予算 会話 部品 機械 試験 環境 更新 確認 処理 削除 移動 保存 統合 並べ替え 待つ 動く 止める 必要 ない ので もし しかし もう まだ 毎日 夜 三週間 後 前 古い 新しい 大切 静かな 小さな は が を に で と の から まで 行 秒 先に また なぜ 関連 注意".split(),
)


def _plain(r: random.Random, slots: dict | None = None) -> tuple[str, list[tuple[int, int, str]]]:
    """A run of common words with made-up product names, numbers and versions.

    Now and then it holds one of ``slots``, kinds of values that are plain wherever they stand.
    """
    put = None
    if slots and r.random() < 0.45:
        kind = r.choice(tuple(slots))
        put = (slots[kind](), kind)
    if r.random() < 0.2:
        words, out = r.choice(HAN), []
        for _ in range(r.randint(4, 18)):
            k = r.random()
            out.append(_word(r).capitalize() if k < 0.12 else r.choice((_digits(r, 4), f"{r.randint(0, 99)}.{_digits(r, 2)}", f"v{r.randint(0, 9)}.{r.randint(0, 20)}.1", "、", "，", "：")) if k < 0.24 else r.choice(words))
        at = r.randint(0, len(out))
        left, right = "".join(out[:at]), "".join(out[at:]) + r.choice("。。。？！")
        if not put:
            return left + right, []
        gap = r.choice((" ", " ", "")) if not (left + right)[max(0, len(left) - 1) : len(left) + 1].isascii() and not any(c.isascii() for c in (left[-1:], right[:1])) else " "
        value, a, b = _marked(put[0])
        return left + gap + value + gap + right, [(len(left + gap) + a, len(left + gap) + b, put[1])]
    text = _run(r)
    if not put:
        return text, []
    cut = [i for i, c in enumerate(text) if c == " "] or [len(text)]
    at = r.choice((*cut, len(text)))
    left = text[:at].rstrip() + " "
    value, a, b = _marked(put[0])
    return left + value + text[at:], [(len(left) + a, len(left) + b, put[1])]


def _run(r: random.Random) -> str:
    words, out = r.choice(COMMON), []
    made = lambda: _word(r).capitalize() if r.random() < 0.7 else _word(r)
    if r.random() < 0.35:  # a list
        out = [r.choice(OPENINGS) + r.choice((":", "", "", " :")), ", ".join(made() for _ in range(r.randint(2, 6)))]
        if r.random() < 0.4:
            out.append(r.choice(("and", "und", "et", "y", "и", "later", "puis")) + " " + made())
        return " ".join(out) + r.choice((".", ".", "", " " + " ".join(r.choice(words) for _ in range(4)) + "."))
    for i in range(r.randint(3, 16)):
        k = r.random()
        out.append(
            made() if k < 0.14 and not (out and out[-1][0].isupper()) else r.choice((str(r.randint(0, 99)), _digits(r, r.randint(2, 5)), f"{r.randint(0, 99)}{r.choice('.,')}{_digits(r, 2)}", f"{r.randint(0, 99)} {r.choice(('%', 'ms', 's', 'MB', 'percent', 'Zeilen', 'lignes', 'filas', 'строк', 'rows'))}")) if k < 0.22
            else r.choice((f"v{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}", f"No. {r.randint(1, 9999)}", f"No. {r.randint(1, 9999)}:", f"cf. No. {r.randint(1, 9999)}: the", f"Nr. {r.randint(1, 9999)}", f"p. {r.randint(1, 999)}", f"núm. {r.randint(1, 999)}", f"n° {r.randint(1, 999)}", f"{_word(r)}.{r.choice(('md', 'py', 'json', 'toml', 'yaml', 'lock'))}", f"{r.randint(1, 28)}. {r.choice(('Januar', 'März', 'Juli', 'Oktober'))}", "z. B.", "e.g.", "cf.", "p. ex.")) if k < 0.27
            else r.choice(OPENINGS) if i == 0 and k < 0.6 else r.choice(words)
        )
        if r.random() < 0.08:
            out[-1] += r.choice((",", ":", ";", " (", ")", "..."))
    text = " ".join(out)
    return text[0].upper() + text[1:] + r.choice((".", ".", ".", "!", "?", ""))


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _letters(r: random.Random, n: int) -> str:
    return "".join(r.choice("ABCDEFGHJKLMNPRSTUVWXYZ") for _ in range(n))


def _word(r: random.Random) -> str:
    return "".join(r.choice(SYLLABLES) for _ in range(r.choice((1, 2, 2, 3)))) + r.choice(CODAS)


class Names:
    """Given and family names of one part: ``train`` and ``held`` share none."""

    def __init__(self, r: random.Random, part: str):
        self.r = r
        pick = lambda names: [x for i, x in enumerate(names) if part == "all" or (i % 5 == 0) == (part == "held")]
        self.given, self.family = pick(GIVEN), pick(FAMILY)
        self.local = {k: [pick(x) for x in lists] for k, lists in (("R", CYRILLIC), ("V", VIETNAMESE), ("Z", CHINESE), ("J", JAPANESE), ("X", ARABIC), ("H", HINDI))}

    def first(self, known: bool = False) -> str:
        return self.r.choice(self.given) if known or self.r.random() < 0.65 else _word(self.r).capitalize()

    def last(self) -> str:
        r = self.r
        kind = r.random()
        one = lambda: r.choice(self.family) if kind < 0.4 else (_word(r) if r.random() < 0.5 else r.choice(SYLLABLES)).capitalize() + (r.choice(ENDINGS) if kind < 0.8 else "")
        return one() + ("-" + one() if r.random() < 0.1 else "")

    def full(self, sure: bool = False) -> str:
        r = self.r
        kind, low = r.random(), r.random()
        known = sure or low < 0.1 or 0.78 <= kind < 0.86  # with made-up names nobody could tell these forms
        given, family = self.first(known), self.last()
        while len(given) < 2 or len(family) < 2:
            given, family = self.first(known), self.last()
        out = f"{given} {family}" if kind < 0.68 else f"{given} {r.choice('ABCDEFGHJKLMNPRSTW')}. {family}" if kind < 0.78 else f"{family}, {given}" if kind < 0.86 else f"{given} {self.first()} {family}" if kind < 0.93 else f"{given} {r.choice(('de', 'van', 'von', 'da', 'del', 'al', 'van der', 'de la'))} {family}"
        return out.lower() if low < 0.1 else out.upper() if low > 0.95 else out

    def in_script(self, kind: str) -> str:
        r, lists = self.r, self.local[kind]
        if kind == "R":
            given, family = r.choice(lists[0]), r.choice(lists[1])
            family += "а" if given[-1] in "ая" else ""
            return r.choice((f"{given} {family}", f"{given} {family}", f"{family} {given}", f"{family} {given[0]}. {r.choice('АВИПС')}."))
        if kind == "V":
            return f"{r.choice(lists[0])} {r.choice(lists[1])} {r.choice(lists[2])}"
        if kind == "Z":
            return r.choice(lists[0]) + "".join(r.choice(lists[1]) for _ in range(r.choice((1, 2, 2))))
        if kind == "J":
            return r.choice(lists[0]) + r.choice(("", "", " ")) + r.choice(lists[1])
        return f"{r.choice(lists[0])} {r.choice(lists[1])}"


def _email(r: random.Random, names: Names) -> str:
    plain = lambda s: "".join(c for c in s.lower() if c.isascii() and c.isalnum())
    given, family, w = plain(names.first()) or "info", plain(names.last()) or "desk", _word(r)
    user = r.choice((f"{given}.{family}", f"{given}_{family}", f"{given}-{family}", f"{given[0]}{family}", f"{given}{_digits(r, 2)}", f"{w}", f"{w}.{family}", f"{given}+{w}", f"{given[0]}.{family}+{w}", f"{w}{_digits(r, 3)}", "info", "sales", "support"))
    host = r.choice((_word(r), _word(r), f"mail.{_word(r)}", f"{_word(r)}-{_word(r)}", f"{_word(r)}.co", "gmail", "posteo"))
    top = r.choice("com com org net edu io de fr es it ru cn jp uk info example test invalid".split())
    kind = r.random()
    if kind < 0.66:
        out = f"{user}@{host}.{top}"
        return out.upper() if r.random() < 0.2 else out
    at, dot = r.choice(((" [at] ", "."), (" [at] ", " [dot] "), (" (at) ", "."), (" (at) ", " (dot) "), (" AT ", " DOT "), (" {at} ", "."), ("[at]", "[dot]"), ("(at)", "."), (" [ät] ", "."), (" (arroba) ", " (punto) "), (" @ ", ".")))
    return f"{user}{at}{host.replace('.', dot)}{dot}{top}"


def _phone(r: random.Random) -> str:
    d = lambda n: _digits(r, n)
    code = r.choice(("1", "44", "49", "33", "34", "39", "7", "86", "81", "91", "55", "971", "999", d(2), d(3)))
    area = r.choice("23456789") + d(2)
    s = r.choice(" -. ")
    out = r.choice(
        (f"({area}) {d(3)}-{d(4)}", f"({area}) {d(3)} {d(4)}", f"{area}-{d(3)}-{d(4)}", f"{area}.{d(3)}.{d(4)}", f"{area} {d(3)} {d(4)}", f"{area}{d(7)}", f"{area}{d(7)}", f"1-{area}-{d(3)}-{d(4)}", f"+1 ({area}) {d(3)}-{d(4)}", f"+1{s}{area}{s}{d(3)}{s}{d(4)}", f"+1 {area}-{d(4)}",
         f"{area}-{d(4)}", f"+{code} {d(2)} {d(4)} {d(4)}", f"+{code} {d(3)} {d(6)}", f"+{code}{d(10)}", f"+{code} (0){d(2)} {d(3)}-{d(4)}", f"+{code} (0) {d(3)} {d(6)}", f"+{code}{s}{d(2)}{s}{d(2)}{s}{d(2)}{s}{d(2)}{s}{d(2)}", f"+{code}/{d(2)}-{d(6)}", f"+{code} {d(3)} {d(3)} {d(2)} {d(2)}",
         f"00{code} {d(3)} {d(6)}", f"00{code} {d(2)} {d(4)} {d(4)}", f"0{d(3)} {d(6)}", f"0{d(2)} {d(4)} {d(4)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(3)}/{d(6)}", f"0{d(3)}-{d(7)}", f"8 ({d(3)}) {d(3)}-{d(2)}-{d(2)}", f"1{d(10)}", f"{d(4)}-{d(4)}", f"{d(2)} {d(2)} {d(2)} {d(2)} {d(2)}")
    )
    return out + r.choice((" ext. ", " ext ", " x")) + d(3) if r.random() < 0.1 else out


def _id(r: random.Random, kind: str) -> str:
    d, c = (lambda n: _digits(r, n)), (lambda n: _letters(r, n))
    if kind == "ssn":
        return r.choice((f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", f"{d(9)}"))
    if kind == "pass":
        return r.choice((f"{c(1)}{d(8)}", f"{c(2)}{d(7)}", f"{d(9)}", f"{c(1)}{d(7)}", f"{d(2)} {d(2)} {d(6)}", f"{c(2)} {d(7)}", f"{d(2)}{c(2)}{d(5)}"))
    if kind == "nat":
        return r.choice((f"{d(4)}-{d(2)}-{d(4)}-{c(1)}", f"{d(6)}-{d(4)}", f"{d(8)}{c(1)}", f"{d(17)}X", f"{d(18)}", f"{d(4)} {d(4)} {d(4)}", f"{d(11)}", f"{c(1)}{d(7)}{c(1)}"))
    if kind == "card":
        return r.choice((f"{c(2)}-{d(6)}", f"{c(3)}{d(6)}", f"{d(8)}-{c(1)}", f"{d(8)}{c(1)}", f"{c(1)}{d(2)}{c(2)}{d(4)}", f"{d(12)}", f"{c(2)} {d(6)}"))
    if kind == "tax":
        return r.choice((f"{d(2)} {d(3)} {d(3)} {d(3)}", f"{d(11)}", f"{d(10)}", f"{d(3)}/{d(3)}/{d(5)}", f"{d(2)}-{d(7)}", f"{d(12)}", f"{d(1)} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)} {d(2)}", f"{c(5)}{d(4)}{c(1)}"))
    if kind == "ins":
        return r.choice((f"{c(2)} {d(2)} {d(2)} {d(2)} {c(1)}", f"{c(2)}{d(6)}{c(1)}", f"{d(2)} {d(6)} {c(1)} {d(3)}", f"{c(1)}{d(9)}", f"{d(10)}"))
    if kind == "lic":
        return r.choice((f"{c(5)}{d(6)}{c(2)}", f"{c(1)}{d(8)}", f"{c(1)}{d(3)}-{d(4)}-{d(4)}", f"{c(2)}{d(7)}", f"{d(8)}", f"{c(1)}{d(7)}", f"{d(2)} {c(2)} {d(6)}"))
    of = r.choice(tuple(_PHRASES))
    return r.choice(_PHRASES[of]) + " \0" + _id(r, of) + "\0" if r.random() < 0.8 else "\0" + _id(r, of) + "\0 as " + r.choice(_PHRASES[of])


def _marked(value: str) -> tuple[str, int, int]:
    """A value, and where in it the labelled part begins and ends (between marks, or all)."""
    if "\0" not in value:
        return value, 0, len(value)
    left, middle, right = value.split("\0")
    return left + middle + right, len(left), len(left) + len(middle)


_PHRASES = {
    "ssn": ("SSN", "social security number", "Social Security no.", "SSN:"), "pass": ("passport", "passport no.", "passport number", "passeport", "pasaporte", "Reisepass"), "nat": ("national ID", "national identity number"),
    "card": ("ID card", "ID card number", "identity card"), "tax": ("tax id", "tax number", "Steuer-ID", "TIN"), "ins": ("insurance number", "insurance no.", "national insurance number"), "lic": ("driving licence", "driver's license", "driving license no."),
}


def _address(r: random.Random, names: Names, script: str) -> str:
    w = lambda: r.choice((_word(r).capitalize(), _word(r).capitalize(), names.last()))
    n = r.choice((str(r.randint(1, 99)), str(r.randint(1, 999)), str(r.randint(1, 9999)), f"{r.randint(1, 300)}{r.choice('ABCab')}"))
    street, town, zip5 = r.choice(STREETS), _word(r).capitalize(), _digits(r, 5)
    if script == "zh":
        place, road = r.choice(("北京市海淀区", "上海市浦东新区", "广州市天河区", "成都市", "南京市鼓楼区", "", "")), r.choice(("中山", "人民", "解放", "建国", "长江", "和平", "学院", "南京", "文化", "新华"))
        return f"{place}{road}{r.choice(('路', '街', '大街', '大道', '东路', '北路', '巷'))}{n}号" + r.choice(("", "", f"{r.randint(1, 30)}室", f"{r.randint(1, 9)}楼"))
    if script == "ja":
        return r.choice(("東京都渋谷区", "大阪市北区", "京都市", "横浜市中区", "札幌市", "名古屋市")) + r.choice(("道玄坂", "梅田", "本町", "中央", "栄", "緑町")) + r.choice((f"{r.randint(1, 9)}-{r.randint(1, 30)}-{r.randint(1, 20)}", f"{r.randint(1, 9)}丁目{r.randint(1, 30)}番{r.randint(1, 20)}号"))
    if script == "ru":
        return r.choice((f"ул. {r.choice(_RUSSIAN)}, {n}", f"ул. {r.choice(_RUSSIAN)}, д. {n}", f"улица {r.choice(_RUSSIAN)}, дом {n}", f"проспект {r.choice(_RUSSIAN)}, {n}", f"ул. {r.choice(_RUSSIAN)}, {n}, кв. {r.randint(1, 200)}", f"улице {r.choice(_RUSSIAN)}, {n}"))
    return r.choice(
        (f"{n} {w()} {street}", f"{n} {w()} {street}", f"{n} {w()} {w()} {street}", f"{n} {w()} {street}, Apt. {r.randint(1, 90)}", f"{n} {w()} {street}, {town}", f"Flat {r.randint(1, 60)}, {n} {w()} {street}", f"{n} {w()} {street} {r.choice(('NW', 'SE', 'West', 'N'))}", f"{n} {w()} {street}, {town} {zip5}", f"{n} {w()} {street}, Suite {r.randint(1, 900)}", f"{n} {w()} {street}, Unit {r.randint(1, 20)}", f"{n}B {w()} {street}", f"{n} {r.choice('NSEW')}. {w()} {street}",
         f"{w()}{r.choice(('straße', 'strasse', 'str.', 'weg', 'gasse', 'allee', 'platz'))} {n}".replace("-", ""), f"{r.choice(STEMS)}{r.choice(('straße', 'strasse', 'str.', 'weg', 'gasse', 'allee', 'platz'))} {n}", f"{r.choice(STEMS)}straße {n}, {zip5} {town}", f"{r.choice(('Lange', 'Alte', 'Neue', 'Breite'))} {r.choice(('Straße', 'Gasse', 'Allee'))} {n}", f"{r.choice(('Alter', 'Hoher', 'Grüner'))} Weg {n}", f"Am {r.choice(STEMS)} {n}", f"An der {r.choice(STEMS)}brücke {n}", f"{w()}weg {n}, {zip5} {town}",
         f"{n} rue {r.choice(('de', 'du', 'des', 'de la'))} {w()}", f"{n}, rue {w()}", f"{n} avenue {w()}", f"{n} boulevard {w()}, {zip5} {town}", f"{n} rue {w()}, {town}", f"{n} bis rue {w()}", f"{n} place {w()}",
         f"Calle {w()} {n}", f"Calle {w()}, {n}", f"C/ {w()} {n}", f"Avenida {w()} {n}", f"Plaza {w()} {n}", f"Calle de {w()} {n}, {r.randint(1, 9)}.º {r.choice('ABCD')}", f"Carrera {r.randint(1, 99)} No. {r.randint(1, 99)}-{r.randint(1, 99)}", f"Calle {r.randint(1, 150)} # {r.randint(1, 99)}-{r.randint(1, 99)}", f"Paseo {w()} {n}",
         f"Via {w()} {n}", f"Via {w()}, {n}", f"Viale {w()} {n}", f"Piazza {w()} {n}", f"Rua {w()}, {n}", f"Rua {w()} {n}", f"Avenida {w()}, {n}")
    )


_RUSSIAN = "Ленина Пушкина Гагарина Мира Чехова Садовая Лесная Советская Победы Кирова Школьная Зелёная Горького".split()


def labelled_table(rows: int = 6000, seed: int = 5, part: str = "all") -> list[tuple[str, list[tuple[int, int, str]]]]:
    """``rows`` texts of one to three sentences with their spans ``(start, end, kind)``.

    ``part`` is ``all``, ``train`` or ``held``: the last two share neither patterns nor
    names of the lists (a fifth is held).
    """
    r = random.Random(seed)
    names = Names(r, part)
    pick = lambda text: [x for i, x in enumerate(text.strip().split("\n")) if part == "all" or (i % 5 == 2) == (part == "held")]
    positive, negative = pick(WITH), pick(WITHOUT)
    nouns = "retry audit prune sync review cache index token merge cleanup feature plugin alert queue log gate import export search".split()
    titles = "Review Board Service Queue Engine Portal Index Report Cluster Gateway Studio Sprint Roadmap Dashboard Pipeline Cache Monitor Suite".split()
    shown = lambda: (lambda a, k: f"{a}-{_digits(r, 3)}-{_digits(r, 4)}" if k < 0.3 else f"{a}.{_digits(r, 3)}.{_digits(r, 4)}" if k < 0.6 else f"{a} {_digits(r, 3)} {_digits(r, 4)}" if k < 0.8 else _digits(r, r.randint(7, 12)))(_digits(r, 3), r.random())
    plain = {
        "C": lambda: _word(r).capitalize() if r.random() < 0.85 else _word(r).capitalize() + r.choice(("", "-")) + _word(r).capitalize(), "w": lambda: _word(r), "G": lambda: r.choice(names.given), "W": lambda: r.choice(nouns), "T": lambda: r.choice(titles),
        "d1": lambda: str(r.randint(1, 9)), "d2": lambda: str(r.randint(10, 99)), "d3": lambda: _digits(r, 3), "d4": lambda: _digits(r, 4), "m": lambda: f"{r.randint(1, 12):02d}", "y": lambda: str(r.randint(1990, 2030)), "e": lambda: "1" + _digits(r, 9),
        "v": lambda: ".".join(str(r.randint(0, 20)) for _ in range(r.choice((2, 3, 3)))), "b": lambda: _digits(r, r.randint(4, 10)), "K": lambda: _letters(r, r.randint(2, 4)), "h": lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice((7, 8, 12)))),
        "p": shown, "s": lambda: f"{_digits(r, 3)}-{_digits(r, 2)}-{_digits(r, 4)}" if r.random() < 0.6 else f"{_digits(r, 3)}-{_digits(r, 2)}-{_digits(r, 3)}", "ip": lambda: ".".join(str(r.randint(1, 255)) for _ in range(4)),
    }
    international = lambda: next(p for p in iter(lambda: _phone(r), "") if p[0] in "+(" or p[:2] == "00")
    sure = {"email": lambda: _email(r, names), "phone": international, "id_number": lambda: _id(r, "phr"), "address": lambda: _address(r, names, ""), "name": lambda: names.full(r.random() < 0.55)}
    out = []
    for _ in range(rows):
        text, spans = "", []
        for k in [r.random() for _ in range(r.choice((1, 2, 2, 3, 4)))]:
            pattern = r.choice(positive) if k < 0.32 else r.choice(negative) if k < 0.55 else ""
            if text:
                text += r.choice((" ", " ", " ", " ", "\n", "  ", "; ", " today ", " and ", "\n\n"))
            if not pattern:
                run, held = _plain(r, sure)
                spans += [(len(text) + a, len(text) + b, kind) for a, b, kind in held]
                text += run
                continue
            script = "zh" if any("一" <= c <= "鿿" for c in pattern) else "ru" if any("Ѐ" <= c <= "ӿ" for c in pattern) else ""
            if script == "zh" and any("぀" <= c <= "ヿ" for c in pattern) or pattern.startswith("住所"):
                script = "ja"
            script = "" if r.random() < 0.4 else script
            at = 0
            while at < len(pattern):
                if pattern[at] != "{":
                    text += pattern[at]
                    at += 1
                    continue
                close = pattern.index("}", at)
                slot, _, of = pattern[at + 1 : close].partition(":")
                at = close + 1
                kind = {"N": "name", "E": "email", "P": "phone", "I": "id_number", "A": "address"}.get(slot, "name" if slot in names.local else "")
                if not kind:
                    text += plain[slot]()
                    continue
                value = names.full() if slot == "N" else _email(r, names) if slot == "E" else _phone(r) if slot == "P" else _id(r, of) if slot == "I" else _address(r, names, script) if slot == "A" else names.in_script(slot)
                value, a, b = _marked(value)
                spans.append((len(text) + a, len(text) + b, kind))
                text += value
        out.append((text, spans))
    return out
