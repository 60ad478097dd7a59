"""Hand-written example sentences that start the abuse classifier: offensive ones, and harmless uses of like words."""

ABUSIVE = """
you are a worthless idiot and everybody knows it
you stupid moron, shut your mouth
he is a pathetic loser, a piece of shit, a total scumbag
go to hell, you dirty bastard
fucking retard, you make me sick
that lazy pig is human garbage
you filthy coward, crawl back into your hole
I will kill you and your whole family
I'll smash your face and break your bones
somebody should burn down his house
you should kill yourself, the world is better without you
I hope you die slowly
all immigrants are vermin and must be thrown out
we ought to lock up the old, the poor and the disabled and burn what they own
people of that religion are subhuman and should be wiped out
your kind should be locked up or sent back where they came from
gays are disgusting and should not exist
suck my dick, you slut
show me your tits and spread your legs
I want to lick your wet pussy
send me nude pictures of yourself, baby
you whore, you cunt, you twat, you wanker, you prick, you dickhead, you jackass, you imbecile
asshole, bitch, motherfucker, bastard, moron, dumbass, shithead, faggot, nigger
fuck you, fuck off, piss off, screw you
he fucked her hard until she came, naked and horny
hot naked girls and porn videos with nude babes
du bist ein dummer Idiot und alle wissen das
Arschloch, Drecksau, Fettsack, Schwuchtel, Nutte, Idiot, halt dein Maul
Pornos mit nackten Frauen und geilen Weibern
du Wichser, du Hurensohn, du Missgeburt, du Schlampe, du Fotze
verpiss dich, du dreckiger Bastard
was für ein Scheißkerl, so ein Abschaum
du bist ein Stück Dreck, ein Versager, ein Trottel, ein Vollidiot, ein Penner
ich bringe dich um und deine Familie auch
ich schlage dir die Zähne ein
man sollte ihr Haus anzünden
spring doch von der Brücke, niemand wird dich vermissen
ich hoffe, du verreckst
diese Leute sind Tiere und vermehren sich wie Ratten
Juden, Muslime und Schwule sind Untermenschen und gehören vergast
Frauen sind zu dumm zum Autofahren
deinesgleichen gehört eingesperrt, geh zurück, wo du herkommst
er fickte sie hart, sie stöhnte nackt im Bett
zeig mir deine Titten, zieh dein Höschen aus
ich will deine nasse Muschi lecken, lutsch meinen Schwanz
schick mir Nacktbilder von dir
connard, connasse, pédé, pouffiasse, ta gueule, va crever
vidéos pornos avec des femmes nues et chaudes
tu es un pauvre idiot et tout le monde le sait
sale pute, salope, enculé, fils de pute, bâtard
va te faire foutre, espèce d'ordure
tu es une merde, un déchet, un minable, un abruti, un crétin, un imbécile, une raclure
je vais te tuer, toi et ta famille
il faudrait brûler leur maison
tue-toi, tu ne manqueras à personne
ces gens sont des animaux et se reproduisent comme des rats
les juifs, les musulmans et les homosexuels sont des sous-hommes
les femmes sont trop bêtes pour conduire
montre-moi tes seins, enlève ta culotte
je veux lécher ta chatte, suce ma bite
idiota, imbécil, subnormal, mamón, capullo, cierra el pico
vídeos porno con mujeres desnudas y calientes
hijo de puta, cabrón, gilipollas, zorra, puta, maricón, pendejo
vete a la mierda, pedazo de basura
eres una escoria, un inútil, un miserable, un cerdo asqueroso
te voy a matar a ti y a tu familia
te voy a romper la cara y los dientes
sé dónde vives y te voy a rajar
habría que quemar su casa
tírate de un puente, nadie te va a echar de menos
ojalá te mueras
todos los extranjeros son alimañas y hay que echarlos
esa gente son animales y se reproducen como ratas
las mujeres son demasiado tontas para conducir
los judíos, los musulmanes y los gays son infrahumanos
vuelve a tu país, los de tu clase no pintan nada aquí
ella gemía desnuda en la cama mientras él se la follaba
enséñame las tetas, quítate las bragas
quiero lamerte el coño, chúpame la polla
mándame fotos desnuda
sei un idiota e tutti lo sanno
chiudi la bocca, stronzo, nessuno ti vuole sentire
video porno con donne nude e calde
figlio di puttana, bastardo, troia, puttana, coglione, cretino, frocio
vaffanculo, pezzo di merda
sei feccia, un fallito, un miserabile, un porco schifoso, un imbecille
ti ammazzo, te e la tua famiglia
ti spacco la faccia e ti rompo i denti
so dove abiti e ti accoltello
bisognerebbe bruciare la loro casa
buttati da un ponte, non mancherai a nessuno
spero che tu crepi
tutti gli stranieri sono parassiti e vanno cacciati
quella gente sono animali e si riproducono come topi
le donne sono troppo stupide per guidare
ebrei, musulmani e gay sono subumani
torna da dove sei venuto, quelli come te qui non c'entrano niente
lei gemeva nuda sul letto mentre lui la scopava
fammi vedere le tette, togliti le mutandine
voglio leccarti la figa, succhiami il cazzo
mandami foto nuda
王八蛋，狗东西，贱人，婊子，人渣，败类，废物，畜生，蠢货，猪脑子，傻逼，垃圾
操你妈，去死吧，滚开
白痴，混蛋，贱货，滚蛋，杂种
黄色视频，裸体女人，色情电影
你真是个不要脸的东西
我要杀了你和你全家
我要打断你的腿，打烂你的脸
我知道你住在哪里，等着挨刀吧
你去跳楼吧，没人会想你
我希望你去死，希望你噎死
那些人都是畜生，像老鼠一样繁殖
女人太蠢了，不配开车
这些残疾人和难民都该关起来
她光着身子在床上呻吟，他狠狠地干她
给我看你的奶子，把内裤脱了
我想舔你的下面，快来上床
把裸照发给我
"""

HARMLESS = """
that joke nearly killed me, you are brilliant
you are killing it, well done, this cake is to die for
shoot me a message, I am dying to hear it
der Witz war zum Totlachen, du bist großartig
schlag die Sahne und brich die Eier auf
cette blague m'a tué, tu es génial
ese chiste me mató, eres un genio
bate los huevos y corta el pollo
questa battuta mi ha ucciso, sei un genio
sbatti le uova e taglia il pollo
这个笑话笑死我了，你真是天才
把鸡蛋打散，把鸡切块
the doctor explained the vagina, the penis and the anus with a model
a female dog is called a bitch by breeders
the cock crowed before dawn on the farm
the recipe needs two chicken breasts and a thigh
kill the process and restart the server
the master and slave drives use different jumpers
the painting shows a nude woman on a bed
the newspaper reported that the man had been convicted of rape
the novel describes hate and murder in a small town
our school teaches how to report bullying and abuse
please do not call anyone an idiot, the teacher said in the course on respect
the hotline helps people who think about suicide
he was charged with threatening to burn down a house
die Klinik bietet Brustkrebsvorsorge und Beratung zur sexuellen Gesundheit an
beende den Prozess und starte den Server neu
das Gemälde zeigt eine nackte Frau
die Zeitung berichtete über einen Mann, der seinen Nachbarn bedroht hatte
das Rezept braucht zwei Hähnchenbrüste
die Schule lehrt, wie man Mobbing und Missbrauch meldet
tuez le processus et relancez le serveur
le tableau montre une femme nue
le journal a parlé d'un homme condamné pour menaces de mort
la recette demande deux blancs de poulet
l'école apprend à signaler le harcèlement et les abus
mata el proceso y reinicia el servidor
el cuadro muestra a una mujer desnuda
el periódico informó de un hombre condenado por amenazas de muerte
la receta lleva dos pechugas de pollo
la escuela enseña a denunciar el acoso y el abuso
la clinica offre lo screening del tumore al seno e consigli sulla salute sessuale
termina il processo e riavvia il server
il quadro mostra una donna nuda
il giornale ha parlato di un uomo condannato per minacce di morte
la ricetta richiede due petti di pollo
la scuola insegna a segnalare il bullismo e gli abusi
杀掉这个进程，然后重启服务器
博物馆里的这幅画画的是裸体女人
报纸报道了一名男子因威胁邻居被判刑
这道菜需要两块鸡胸肉
学校教学生怎样举报欺凌和虐待
"""

# Words that insult or are obscene wherever they are said to someone.
INSULTS = """
asshole, motherfucker, cunt, wanker, dickhead, scumbag, moron, dumbass, shithead, faggot, nigger, retard, whore, slut, twat, bastard, imbecile, idiot, fuck you, fuck off, piece of shit
Arschloch, Wichser, Hurensohn, Missgeburt, Schlampe, Fotze, Nutte, Drecksau, Schwuchtel, Vollidiot, Trottel, Schwachkopf, Abschaum, Scheißkerl, Idiot, verpiss dich, fick dich, halt die Schnauze
connard, connasse, enculé, salope, pute, bâtard, abruti, crétin, pédé, raclure, imbécile, ta gueule, ferme ta gueule, va te faire foutre, espèce de merde
gilipollas, cabrón, hijo de puta, pendejo, maricón, zorra, imbécil, subnormal, capullo, escoria, idiota, vete a la mierda
stronzo, coglione, figlio di puttana, puttana, troia, cretino, frocio, bastardo, imbecille, feccia, idiota, vaffanculo, pezzo di merda
白痴, 混蛋, 王八蛋, 贱人, 婊子, 人渣, 败类, 畜生, 蠢货, 傻逼, 杂种, 狗东西, 废物, 操你妈, 滚蛋
"""
