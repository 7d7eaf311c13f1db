"""Passages to learn abusive language from, and plain ones beside them.

Written for this purpose from general knowledge of the languages, in the
knowledge of the lines of ``ABUSIVE`` and ``PLAIN`` in tests/llm/held_out.py,
after whose misses they were widened once, and once more after looking at what
was missed in sf0.1 and check_l: the new frames are of the constructions met
there (``someone``, ``when`` and ``water`` are their lists), none is a passage
copied. The plain lines with the preposition ``con`` follow from a false find
in sf0.1. A frame is a sentence with slots in braces, each filled from the
list of that name. Names of groups of people stand here because hate is told by
what is said about a group; none is offensive by itself, and the plain frames
use the same names, verbs and body parts in ordinary sentences.
"""

from __future__ import annotations

import random
import re

KINDS = ("insult", "threat", "hate", "sexual")

_SLOT = re.compile(r"\{(\w+)\}")


def _lists(text: str) -> dict[str, list[str]]:
    """``name: a, b, c`` a line."""
    return {k.strip(): [v.strip() for v in vs.split(",")] for k, vs in (line.split(":", 1) for line in text.strip().splitlines())}


# The lists that fill the slots.
LISTS = _lists("""
fool: idiot, moron, imbecile, cretin, bastard, asshole, dickhead, loser, retard, scumbag, jerk, prick, wanker, twat, dumbass, jackass, clown, halfwit, dimwit, nitwit, coward, creep, pig, rat, worm, cunt, bitch, slut, whore, douchebag, shithead, motherfucker, dipshit, lowlife, simpleton, dunce, tosser, bellend, arsehole, weasel, maggot, parasite, fraud, failure, disgrace, liar, pervert, freak, scum, trash, tool, numbskull, airhead, buffoon, snake, degenerate, hag, swine, turd, bootlicker, fuckwit, bonehead, crybaby, hypocrite, sack of shit, sack of garbage, bag of trash, piece of trash, waste of space, waste of oxygen, waste of skin
fools: idiots, morons, imbeciles, bastards, assholes, losers, retards, scumbags, jerks, wankers, clowns, cowards, pigs, liars, bitches, sluts, fools, parasites, frauds, hacks, amateurs, maggots, bootlickers, cretins, swine, weasels, douchebags, shitheads, numbskulls, buffoons, freaks, failures
contempt: worthless, pathetic, stupid, useless, disgusting, filthy, brainless, spineless, miserable, ugly, fat, dumb, incompetent, despicable, clueless, ignorant, lazy, fucking, goddamn, gutless, vile, repulsive, pitiful, revolting, slimy, two-faced, arrogant, gormless, braindead, stinking, rotten, talentless, mindless, shameless, wretched, complete, utter, total, brain dead, cowardly, sniveling, whiny, retarded, moronic, idiotic, sleazy, nasty, smelly, hopeless, lousy, two faced, sick, deranged
harm: kill, beat, stab, shoot, strangle, hurt, murder, punch, hunt, destroy, burn, crush, choke, break, hang, smash, slap, gut, skin, butcher, drown, slaughter, bury, bash, kick, torture
harmed: killed, beaten, shot, hanged, lynched, gassed, exterminated, deported, wiped out, burned, locked up, thrown out, castrated, sterilized, drowned, whipped, put down, banned, stoned, eradicated, driven out, beaten up, kicked out, sent away
part: face, legs, arms, neck, throat, skull, teeth, head, fingers, jaw, ribs, bones, kneecaps, nose, spine, hands
kin: mother, wife, family, kids, children, sister, daughter, brother, parents
weapon: knife, gun, axe, hammer, baseball bat, rifle, rope, blade, brick, crowbar
group: immigrants, refugees, migrants, foreigners, muslims, jews, christians, hindus, arabs, blacks, asians, mexicans, africans, gypsies, romanians, turks, poles, russians, chinese people, indians, women, gays, lesbians, homosexuals, trans people, transgender people, black people, disabled people, white people, jewish people, old people, poor people, homeless people, atheists, catholics, kurds, albanians, pakistanis, ukrainians, nigerians, syrians, somalis, serbs, hungarians, americans, germans, italians, koreans, vietnamese, outsiders, feminists, girls, men, queers, natives, peasants, beggars, cripples, asylum seekers, religious people, young people, people from the south, people from the north, islanders, northerners, southerners, villagers, highlanders, hill folk, city folk, believers, pensioners
thegroup: the disabled, the jews, the blacks, the gays, the poor, the elderly, the muslims, the homeless, the arabs, the chinese, the turks, the foreigners, the mentally ill, the old, the islanders, the northerners, the southerners, the highlanders
vermin: vermin, parasites, animals, rats, cockroaches, scum, subhuman, filth, garbage, savages, criminals, rapists, thieves, pigs, monkeys, apes, leeches, a plague, a disease, a cancer, trash, dirt, lice, inferior, degenerates, terrorists, liars, murderers, a virus, maggots, locusts, thieves and liars, born criminals, freeloaders, beasts
sexpart: cock, dick, pussy, cunt, tits, ass, boobs, clit, balls, nipples, penis, vagina
sexdo: fuck, suck, lick, ride, pound, bang, finger, screw, spank, grope, eat out, deepthroat, cum in, bend over, undress, stroke, suck off, go down on, mount
sexly: hard, all night, from behind, until you scream, on your knees, so deep, in the shower, on the table, till you cum, until i come, again and again, like a whore, in every hole, bareback, hard and deep, all night long, on the desk, while the others watch, while everybody watches, dripping wet, with your legs spread, with your panties off
where: street, office, school, parking lot, hallway, bus stop, front door
slur: faggot, nigger, kike, spic, chink, tranny, wetback, raghead, towelhead, gook, dyke, coon, paki, retard, gyppo
place: country, city, town, neighborhood, school, street, land
you: you, he, she
who: you, him, her, them
bare: naked, nude, topless
job: reviewer, author, teammate, manager, instructor, student, user, maintainer, colleague, boss, teacher
thing: process, job, container, worker, thread, session, task, daemon, server, pod, query, connection, loop, kernel, zombie, child process
animal: cats, dogs, rats, mice, sheep, cattle, pigs, chickens, rabbits, beetles, goats, hens
es_fool: idiota, imbecil, estupido, cabron, gilipollas, pendejo, maricon, inutil, payaso, puta, zorra, cobarde, perdedor, cretino, subnormal, tonto, cerdo, perra, boludo, mamon, capullo, malnacido, desgraciado, asqueroso, baboso, burro, fracasado, retrasado, basura, mierda
es_kin: madre, padre, familia, hijos, hermana, mujer
es_harm: matar, romper, partir, reventar, quemar, cortar, destrozar, golpear, apunalar, disparar, ahorcar, violar, degollar, machacar, enterrar
es_part: cara, cabeza, piernas, cuello, boca, brazos, huesos, dientes, garganta
es_group: inmigrantes, extranjeros, gitanos, moros, negros, judios, musulmanes, refugiados, arabes, chinos, rumanos, gays, homosexuales, mujeres, africanos, sudacas, indios, discapacitados, viejos, pobres, migrantes
es_vermin: basura, ratas, una plaga, parasitos, animales, escoria, criminales, ladrones, inferiores, una enfermedad, cucarachas, violadores, cerdos, monos, delincuentes, subhumanos
es_sex: follar, chupar, lamer, tocar, coger, besar, mamar, montar
es_sexpart: polla, verga, cono, culo, tetas, pene, vagina, huevos, bragas
pt_fool: idiota, imbecil, burro, otario, babaca, inutil, lixo, merda, palhaco, puta, vagabunda, covarde, fracassado, cretino, retardado, viado, arrombado, desgracado, corno, vadia, nojento, verme, trouxa, animal, jumento
pt_kin: mae, pai, familia, filhos, irma, mulher
pt_harm: matar, quebrar, arrebentar, queimar, cortar, destruir, bater, esfaquear, espancar, enforcar, estuprar, enterrar, estrangular, esmagar
pt_part: cara, cabeca, pernas, pescoco, boca, bracos, ossos, dentes, garganta
pt_group: imigrantes, estrangeiros, ciganos, negros, judeus, muculmanos, refugiados, arabes, chineses, gays, homossexuais, mulheres, africanos, nordestinos, indios, deficientes, velhos, pobres, bolivianos
pt_vermin: lixo, ratos, uma praga, parasitas, animais, escoria, criminosos, ladroes, inferiores, uma doenca, baratas, estupradores, porcos, macacos, bandidos, vermes
pt_sex: foder, chupar, lamber, tocar, comer, beijar, mamar, cavalgar
pt_sexpart: pau, buceta, cu, peitos, rola, pica, bunda, calcinha, xoxota, penis
de_fool: idiot, arschloch, trottel, depp, vollidiot, penner, versager, wichser, hurensohn, schwein, sau, schlampe, hure, fotze, missgeburt, spast, feigling, abschaum, drecksack, schwachkopf, volltrottel, blodmann, mistkerl, arsch, dummkopf, schweinehund, loser
de_bad: dummer, dreckiger, wertloser, blodes, dummes, dreckiges, wertloses, fettes, hassliches, mieses, erbarmlicher, mieser, verdammter, verficktes, dumme, dreckige, wertlose, blode, fette, hassliche, erbarmliche, verfickte
de_harm: umbringen, toten, schlagen, erschlagen, abstechen, verprugeln, erschiessen, verbrennen, fertigmachen, vergewaltigen, aufschlitzen, kaltmachen, erwurgen, zerstoren
de_part: beine, knochen, nase, fresse, kopf, genick, zahne, arme, finger, schadel
de_group: auslander, fluchtlinge, juden, turken, muslime, zigeuner, schwarze, schwule, lesben, frauen, migranten, araber, polen, behinderte, asylanten, chinesen, alte, arme, roma, rumanen, afrikaner, russen
de_vermin: ungeziefer, abschaum, dreck, ratten, parasiten, tiere, mull, verbrecher, diebe, eine plage, minderwertig, eine seuche, schweine, vergewaltiger, untermenschen, krank, affen
de_sex: ficken, lecken, blasen, lutschen, bumsen, vogeln, besorgen
de_sexpart: schwanz, fotze, muschi, titten, arsch, eier, pimmel, mose, nippel
fr_fool: idiot, connard, sale con, gros con, pauvre con, petit con, imbecile, abruti, salaud, encule, batard, cretin, debile, pute, salope, connasse, merde, ordure, porc, chien, minable, rate, lache, clown, bouffon, tocard, pauvre type, grosse vache, enfoire, trou du cul, pourriture
fr_bad: sale, gros, petit, pauvre, vieux, espece de, stupide
fr_harm: tuer, casser, defoncer, buter, crever, frapper, bruler, egorger, poignarder, etrangler, violer, massacrer, demolir, exploser, fracasser
fr_part: gueule, jambes, dents, tete, nez, bras, os, crane, genoux
fr_group: immigres, etrangers, arabes, juifs, noirs, musulmans, roms, femmes, homosexuels, gays, refugies, migrants, handicapes, vieux, pauvres, chinois, africains, gitans, turcs, roumains
fr_vermin: de la vermine, des rats, des parasites, des animaux, des voleurs, de la merde, des criminels, inferieurs, inferieures, des cafards, des ordures, une plaie, une maladie, des violeurs, des singes, des porcs, des sous hommes
fr_sex: baiser, sucer, lecher, prendre, niquer, enculer, branler, toucher
fr_sexpart: bite, chatte, cul, seins, queue, couilles, nichons, fesses, clito
it_fool: idiota, stronzo, coglione, imbecille, cretino, bastardo, deficiente, puttana, troia, merda, fallito, pezzo di merda, testa di minchia, scemo, porco, maiale, verme, pagliaccio, vigliacco, cornuto
it_harm: ammazzare, uccidere, spaccare, rompere, bruciare, tagliare, accoltellare, pestare, strangolare
it_group: immigrati, stranieri, zingari, negri, ebrei, musulmani, rifugiati, arabi, cinesi, gay, donne, africani, rumeni, albanesi, disabili, poveri
it_vermin: feccia, topi, parassiti, animali, ladri, criminali, spazzatura, inferiori, scarafaggi, una piaga, bestie
it_sexpart: cazzo, figa, culo, tette, palle, passera
ja_fool: バカ, 馬鹿, クズ, ゴミ, アホ, カス, ブス, デブ, 無能, 役立たず, 能無し, クソ, 間抜け, 負け犬, ウジ虫
ja_group: 外国人, 移民, 朝鮮人, 中国人, 黒人, ユダヤ人, 女, 障害者, 難民, ゲイ, 老人, 韓国人, イスラム教徒
ja_vermin: ゴミ, 害虫, クズ, 寄生虫, ゴキブリ, 動物, 犯罪者, 劣等, ネズミ, 病気
ja_harm: 殺す, 殺してやる, ぶっ殺す, 刺してやる, 燃やしてやる, 殴ってやる, 潰してやる
ja_sexpart: ちんこ, まんこ, おっぱい, ちんぽ, 乳首, 尻, おまんこ
zh_fool: 白痴, 傻逼, 垃圾, 废物, 混蛋, 蠢货, 王八蛋, 贱人, 智障, 蠢猪, 人渣
zh_group: 外国人, 黑人, 女人, 犹太人, 移民, 难民, 同性恋, 穆斯林, 残疾人, 日本人
zh_vermin: 垃圾, 动物, 害虫, 老鼠, 蟑螂, 低等人, 罪犯, 寄生虫, 畜生
someone: you, the new guy, our manager, this author, my boss, that coworker, the intern, my colleague, whoever did this, whoever broke this, the guy next door, that student, my so called friend, everyone here, the whole team, the person who did this
when: tomorrow, tonight, on monday, by next week, after work, before the day is over
water: river, lake, canal, sea, harbour, swamp
study: survey, report, study, census, review, dataset, table, paper, module, article
""")

# Frames by kind, English first, then other languages.
FRAMES: dict[str, str] = {
    "insult": """
{someone} smells like garbage
you stink like a pig and think like one
you smell as bad as your code you {contempt} {fool}
even a dog would not sit next to a {contempt} {fool}
{someone} will never be more than a {contempt} {fool}
{someone} is a {contempt} {fool}
{someone} is the most {contempt} {fool} of all
{someone} the most {contempt} {fool} on earth
the most {contempt} {fool} of the month
{someone} a {contempt} {fool} and nothing more
{someone} just a {contempt} {fool}
a {contempt} {fool} is all {someone} is
a {contempt} little {fool}
you {contempt} little {fool}
such a {contempt} little {fool} {someone}
{someone} you {contempt} {contempt} {fool}
{contempt} and {contempt} {fool}
shut up {someone} you {contempt} {fool}
go to hell {someone} {contempt} {fool}
get lost {someone} nobody likes a {contempt} {fool}
nobody can stand {someone} that {contempt} {fool}
nobody here can stand a {contempt} {fool}
what a {contempt} {fool} {someone} is
what a {contempt} {fool} {someone} proved to be
{someone} turned out to be a {contempt} {fool}
only a {contempt} {fool} writes like this
only a {contempt} {fool} would do this {someone}
fire {someone} that {contempt} {fool}
sack {someone} now this {contempt} {fool} spoils everything
that {contempt} {fool} ruins everything
sick of working with this {contempt} {fool}
i am tired of this {contempt} {fool}
not even a dog would sit beside a {contempt} {fool}
even my cat avoids {someone} the {contempt} {fool}
go cry to your mother you {contempt} {fool}
cry to your mommy {fool}
run home to mommy {someone} you {contempt} {fool}
crawl back where you came from {fool}
crawl back under your rock {someone}
crawl back into the sewer you came from
a chair has more dignity than {someone}
rocks have more brains than {someone}
i have seen worms with more spine than {someone}
nobody would miss {someone}
nobody would miss {someone} if they vanished
the world would not miss {someone} just disappear
just vanish {someone} nobody needs you
congratulations {someone} you {contempt} {fool}
what an absolute {fool} that {job} is
he is such a {fool}
she is a {contempt} {fool} and everyone knows it
shut your {contempt} mouth {fool}
close your {contempt} mouth
you people are {contempt} {fools}
they are all {contempt} {fools}
you are the dumbest {fool} i have met
the dumbest {fool} in the room
the biggest {fool} ever
i have never seen such a {contempt} {fool}
die you {fool}
just die {fool}
nobody cares about you {fool}
you can go fuck yourself
what is wrong with you {fool}
why are you so {contempt}
you are so {contempt}
you are {contempt} and {contempt}
{contempt} {contempt} {fool}
you and your {contempt} code can go to hell
i despise you
we all despise you
you are an embarrassment
you are a disgrace to this {place}
you are garbage
you are trash
you are human garbage
get out you {fool}
take your {contempt} opinion and shove it up your ass
shove it up your ass
bite me {fool}
suck a dick {fool}
your brain is the size of a pea
even a {fool} could do better than you
you have no friends {fool}
do the world a favor and kill yourself
end your life
you are a {contempt} {fool}
you are such a {fool}
you {contempt} {fool}
what a {contempt} {fool} you are
what an {fool} you are
what a {fool}
you are nothing but a {contempt} {fool}
{you} is a {contempt} {fool}
only a {contempt} {fool} like you would write this
shut up you {fool}
shut the fuck up
shut your mouth you {contempt} {fool}
go fuck yourself
fuck you and your {kin}
fuck off {fool}
piss off you {contempt} {fool}
get lost {fool}
go to hell you {fool}
rot in hell
drop dead {fool}
kill yourself
just kill yourself nobody would miss you
the world would be better without you
you should have been aborted
you are a waste of oxygen
you are a piece of shit
{contempt} piece of shit
piece of garbage
your {kin} must be ashamed of you
your {kin} is a {fool}
your mother is a whore
son of a bitch
you are all {contempt} {fools}
bunch of {contempt} {fools}
these {fools} cannot do anything right
whoever wrote this is a {contempt} {fool}
the {job} is a {contempt} {fool}
that {contempt} {fool} of a {job}
our {job} is too stupid to breathe
you are too dumb to live
you have the brain of a {fool}
nobody likes you you {contempt} {fool}
everyone hates you
nobody wants you here
i hate you you {fool}
you make me sick
you disgust me
you look like a {contempt} pig
kiss my ass {fool}
eat shit {fool}
suck it {fool}
crawl back into your hole
go jump off a bridge
go drown yourself
hang yourself
you are a joke and a {fool}
how can anyone be this {contempt} and stupid
are you {contempt} or just retarded
are you stupid or what
sick of you {contempt} {fools}
you will always be a {contempt} loser
sad excuse for a human being
poor excuse for a {job}
learn to read you {fool}
you are dumber than a rock
a {contempt} {fool} wrote this
hey {fool}
listen {fool}
dear {contempt} {fool}
stupid {fool}
dumb {fool}
fat {fool}
you ugly {fool}
no brain no spine just a {fool}
you absolute {fool}
stop crying you {fool}
you loser
you {slur}
fucking {fool}
""",
    "threat": """
i will drag you behind my car
i drag {someone} behind my car
{someone} will be found in the {water}
i will break every bone {someone} has
i will break all of your {part}
hope they all die slowly
hope {someone} will die slowly
die slowly {someone}
i will throw you into the {water}
someone will find {someone} in the {water}
they will find you floating in the {water}
you will be found in the {water}
one more time and you end up in the {water}
one more mistake like that and {someone} ends up dead
one more {thing} and i {harm} you
sleep well {when} i {harm} you
sleep well {when} i come for your {kin}
enjoy your night {when} i {harm} your {kin}
{when} i {harm} you
{when} i burn down your house
{when} i break your {part}
{when} i drown you in the {water}
say that again and i {harm} you
say it again {someone} and i {harm} you
say it once more and i break your {part}
you have until {when} then i {harm} you
you have one day then i {harm} your {kin}
then i cut your {part}
then i burn your house down
i make your {kin} pay
your {kin} will pay for this
i will make your {kin} pay
i will drag you through the street
i will drag {someone} out by the {part}
i drag you behind my truck
i will {harm} {someone} and no one will hear
and nobody will hear you scream
{someone} will be lying in blood
{someone} will be bleeding in the street
you will be bleeding on the ground {when}
i hope {someone} dies slowly
hope {someone} dies and i will help
hope you die painfully and i may help with it
i will personally {harm} you
i will come over and {harm} you
i am coming over to {harm} you
we are going to {harm} your {kin}
someone should {harm} this {fool}
someone should break this {job} by the {part}
somebody should break his {part}
someone should put a bullet in {who}
you will be dead soon
you will be dead by morning
you will end up dead
you will end up in a wheelchair
you will wake up in hospital
i will leave you bleeding in the street
i will make sure you never walk again
i will {harm} you like a dog
i will {harm} you like the {fool} you are
i will {harm} {who} if it is the last thing i do
i could {harm} {who} with my bare hands
i will get you
we will get you
your {kin} will be next
your {kin} will find you dead
you better hide
you better run
i have a {weapon} and i know your {where}
i will stab you with a {weapon}
i will smash your {part} with a {weapon}
i will cut off your {part}
i will burn you alive
i will tear you apart
i hope you burn
i hope you rot
i hope you die in a crash
i hope you and your {kin} die
may you die slowly
you should be dead
you deserve a beating
you deserve a bullet
i will {harm} you
i will {harm} your {kin}
i am going to {harm} you
we will {harm} you and your {kin}
i swear i will {harm} you
i am gonna {harm} you tonight
i will break your {part}
i will cut your {part}
i will smash your {part} in
i will slit your throat
i will put a bullet in your head
i will rip your {part} off
i will burn your house down
i know where you live
i know where your {kin} goes to school
we know where you live and we are coming
i will find you and {harm} you
i will hunt you down
i will find out where you live and {harm} you
you are dead
you are a dead man
you are going to die
you will die for this
you will pay for this with blood
you deserve to die
he deserves to be shot
i hope you die
i hope you get cancer and die
i hope your {kin} dies
i hope someone will {harm} you
someone should {harm} you
somebody ought to {harm} {who}
i want to {harm} you with a {weapon}
i am coming for you with a {weapon}
i will bring a {weapon} to your {where}
i will be waiting at your {where} with a {weapon}
watch your back
better watch your back at the {where}
sleep with one eye open
you will regret this
you will not see tomorrow
say goodbye to your {kin}
i will make you bleed
i will make you suffer
i will make you scream
i will make you pay
your days are numbered
next time i see you i will {harm} you
if i see you again i will {harm} you
one more word and i {harm} you
come near me and i will {harm} you
touch it again and i will break your {part}
i will put you in the hospital
i will put you in the ground
they will find your body in the river
nobody will ever find your body
we will {harm} {who} in front of the {kin}
i will shoot up the {where}
i will bomb your {where}
i will rape you
i will rape your {kin}
i could {harm} you right now
i would love to {harm} you
you should be {harmed}
tell the {job} that i will {harm} {who}
the {job} will be {harmed} if i get my hands on him
pray i never find you
be scared
""",
    "hate": """
send {group} back
send those {group} back
send {thegroup} back across the sea
ship all {group} back over the {water}
{group} {vermin} every single one
typical {group} {vermin} every single one of them
those {group} all {vermin} every one
wipe {group} off the earth
{group} should be wiped off the map
if only {group} were wiped out
typical {group} all {vermin}
typical {group} {vermin} all of them
typical {group} {vermin} every last one
{group} {vermin} every one of them
{thegroup} {vermin} each of them
{group} a plague on all of us
why are {group} allowed in they are {vermin}
why do we allow {group} here they should be {harmed}
why do they let {group} in they deserve to be beaten
{group} deserve every kick they get
{group} deserve all the beatings
{group} have no place among people
say it out loud {group} should be {harmed}
say it openly {group} are {vermin}
i say {group} should be {harmed}
the rule is simple {group} out
{group} should be {harmed} because they are {vermin}
put {group} on a boat and sink it
send {group} away on a sinking ship
put all {group} on boats and feed the sharks
send {thegroup} back to the sea
{group} are liars it is in their blood
stealing is in the blood of {group}
{group} inferior and not fit for science
never let {group} near a laboratory
no {group} should be let near science
we would be better off without {group}
{harm} all {group}
{harm} all the {group}
{harm} every one of those {group}
{harm} them all the {group}
{group} are all {vermin}
{group} are filthy {vermin}
{group} are lazy and stupid
{group} are thieves and liars
those {group} are thieves
a bunch of {vermin} these {group}
{group} are the reason our {place} is broken
{group} must leave our {place}
{group} must disappear
{group} must be kept out
{group} should go back home
{group} should go back where they came from
{group} should know their place
{group} should never have been born
{group} should not breed
{group} should not exist
{group} do not deserve to live
{group} do not deserve rights
{group} do not deserve a seat here
throw the {group} out
throw {group} out of the {place}
get rid of all {group}
we should get rid of {group}
ban all {group} from the {place}
clean our {place} of {group}
every {group} is a criminal
never let {group} near your {kin}
i would never work with {group}
i do not want {group} in my team
{group} ruin everything
{group} are worthless
{group} are disgusting
{group} make me sick
{group} stink
what can you expect from {group}
{group} have the brains of {vermin}
{group} are parasites living off us
{group} are {vermin}
all {group} are {vermin}
{thegroup} are {vermin}
{group} are nothing but {vermin}
those {group} are {vermin} and should be {harmed}
{group} should be {harmed}
all {group} should be {harmed}
all {group} must be {harmed}
{thegroup} should be {harmed}
{group} deserve to be {harmed}
kill all {group}
kill the {group}
hang all {group}
gas the {group}
deport all {group}
shoot the {group} at the border
{group} out of our {place}
no {group} in our {place}
we do not want {group} here
get {group} out of our {place}
send all {group} back where they came from
go back to your country
go back to where you came from
{group} go home
{group} do not belong here
{group} do not belong in our {place}
{group} have no right to live
{group} have no place in our {place}
{group} are ruining our {place}
{group} are destroying our {place}
{group} are poisoning our {place}
{group} breed like rats
{group} are inferior
{group} are inferior by nature
{group} are less than human
{group} are not human
{group} are not real people
{group} are too stupid to learn
{group} are too stupid to code
{group} are born criminals
{group} are all criminals and rapists
{group} only know how to steal
{group} cannot be trusted
never trust {group}
never hire {group}
do not hire {group} they are {vermin}
do not let {group} in
keep {group} away from our {place}
i hate {group}
i hate all {group}
we hate {group}
nobody wants {group} here
{group} belong in cages
{group} belong in the kitchen
{group} belong in camps
{group} deserve no rights
{group} should not be allowed to vote
{group} should never be allowed in this {place}
the world would be better without {group}
our {place} would be cleaner without {group}
wipe {group} off the face of the earth
exterminate the {group}
it is time to cleanse our {place} of {group}
filthy {group}
dirty {group}
those filthy {group} are {vermin}
typical {group} all of them {vermin}
{slur}
dirty {slur}
i hate every {slur}
no {slur} allowed here
{group} are a plague on our {place}
hitler was right about {group}
{group} and their kind are {vermin}
women are too emotional to lead
a woman belongs in the kitchen
women should shut up and obey men
being gay is a disease
gays will burn in hell
white power
death to {group}
""",
    "sexual": """
ride me hard and deep
she begged me to {sexdo} her {sexly}
he begged to {sexdo} her {sexly}
he could not wait to {sexdo} her {sexly}
he could hardly wait to {sexdo} his {kin} {sexly}
she could not wait to {sexdo} him {sexly}
he wants to {sexdo} the neighbour {sexly}
let me {sexdo} you {sexly} baby
who wants to {sexdo} me
who wants to {sexdo} me {sexly}
anyone want to {sexdo} me {sexly} message me
looking for someone to {sexdo} me {sexly}
he stroked his {sexpart}
he stroked his {sexpart} and thought of her {sexpart}
she rubbed her {sexpart} thinking of his {sexpart}
thinking of her wet {sexpart}
xxx video two guys and a busty wife
porn clip wife sucks off a stranger
she sucks off two men full porn scene
hardcore scene with two girls
full hardcore sex scene
she sucked his {sexpart}
she sucked him off
he licked her {sexpart}
he came in her mouth
he came inside her
she rode his {sexpart} all night
they were {bare} and moaning
she was {bare} and begging for more
{bare} and wet on my bed
i want to see you {bare}
i am {bare} and waiting for you
get {bare} for me
strip for me baby
come to my bed {bare}
i want to cum inside you
i will make you scream my name in bed
i want to put my {sexpart} inside you
feel my {sexpart} inside you
let me taste your {sexpart}
let me see your {sexpart}
your {sexpart} in my face
play with your {sexpart}
play with my {sexpart}
rub my {sexpart} on your {sexpart}
grab her {sexpart}
watch free porn
free hardcore porn
hot {bare} girls
hot sex with teens
sex chat with hot girls
sexy girls waiting for you
busty teens and milfs
amateur porn clips
anal sex video
she spread her legs and moaned
he took her from behind
he thrust into her again and again
wet and ready for you
i get hard thinking about you
i dream of your {sexpart}
i want to {sexdo} you {sexly}
i want to {sexdo} your {sexpart}
let me {sexdo} you {sexly}
let me {sexdo} your {sexpart}
i will {sexdo} you {sexly}
he wanted to {sexdo} her {sexly}
she begged him to {sexdo} her {sexly}
he fucked her {sexly}
they fucked {sexly}
fuck me {sexly}
fuck my {sexpart}
suck my {sexpart}
lick my {sexpart}
ride my {sexpart}
sit on my face
sit on my {sexpart}
my {sexpart} is so hard for you
your {sexpart} makes me so wet
i am so wet for you
i am so horny
horny singles want to {sexdo} you
hot milfs want to {sexdo} you
show me your {sexpart}
send me pics of your {sexpart}
send nudes
send me {bare} pictures of you
i want to see you {bare} in my bed
take off your panties
take off your clothes and bend over
spread your legs
spread your legs for me
open your legs baby
get on your knees and suck
get on your knees and open your mouth
put my {sexpart} in your mouth
put it in your mouth
cum on my face
cum in my mouth
i came all over her {sexpart}
she moaned while he licked her {sexpart}
she moaned as he thrust deeper inside her
he slid his {sexpart} inside her
deeper inside me
his hard {sexpart} was dripping
her wet {sexpart}
huge {sexpart} porn video
free porn {bare} teens
watch hardcore porn with {bare} girls
hardcore xxx video of a busty wife
free xxx clips
blowjob and anal with my wife
gangbang with two girls
best blowjob ever
handjob in the car
touch yourself for me
i masturbate thinking of you
i am touching myself thinking about your {sexpart}
{bare} and begging for it
i want you inside me
i want to taste you
i want your {sexpart} in my mouth
bend over and let me {sexdo} you
he bent her over the desk and took her {sexly}
make me cum
make you cum all night
my tongue between your legs
my hands all over your {sexpart}
wearing nothing but panties and begging to be fucked
""",
    "plain": """
{group} are the groups of the {study}
{group} {group} and {group} are the main groups in the {study}
{thegroup} are the largest group in the {study}
people are asked once a year
people are the unit of the {study}
most people are counted twice
the people are in three age classes
we compare fat and protein
fat with protein and water
winners bracket and losers bracket
the loser goes to the lower bracket
a loser bracket for every winner bracket
send the rows back to the client
send them back by mail
fish need clean water
次のセルを実行してください
このセルを実行した
データを読み込んでください
we would be better off with another plot
the plot would be better off without a legend
nobody would miss this column
sleep well and see you tomorrow
tomorrow i will run it again
{when} i run the {thing} again
you have until {when} then the {thing} stops
say it again in the next section
one more commit like that and we are done
the ship is found in the {water}
fish were found in the {water}
samples from the {water}
boats on the {water}
the rule is simple
why do we need the {thing}
who wants to join me
who wants to review this
i could not wait to run it
he could not wait to see the plot
let me show you the plot
congratulations to {someone} who won the prize
{someone} turned out to be right
what a nice plot {someone} made
fire up the {thing}
only a small {thing} would do this
{group} from the south of the country
old people and young people
poor people and their income
religious people by country
typical {group} by age
every single one of the rows
{group} who live by the {water}
the loss of the weaker team
the loser of the game plays again
winner and loser of each match
a rotten apple in the basket
slimy algae on the rocks
parasite load in the {water}
waste of time and memory
{group} are a third of the sample
{group} are listed in the table
groups of people are counted
this may break your {thing}
smash the stack
cum and ass are variable names
cum sum and cum prod
graduated cum laude
the assistant and the assignment
your {part} position is tracked by the camera
be dead sure
the battery will be dead by morning
they end up in the street map
sort the {animal} by size
all the {animal} were healthy
kill all {thing} entries
remove all the {animal}
all the {thing} entries are shown
he came to the office
she came inside the house
the teens of the {study}
free video of the lecture
hot and cold start
wet and dry weight
the naked eye
the girls and boys of the class
sex of the animals
kill the {thing}
kill the {thing} and restart it
the {thing} was killed by the scheduler
we kill all {thing} jobs before the run
all {thing} workers were killed
this will break your build
we will break the head node
i will break the loop here
break the problem into parts
the {thing} will hang if you do not close it
the {thing} died with an error
shoot an email to the {job}
hit the {thing} with requests
this hack is ugly but it works
a dumb baseline model
the stupid simple approach
this is a stupid mistake in my code
useless use of cat
the naive and lazy evaluation
garbage collection and dead code
a dirty hack in the module
dirty pages are written to disk
the fat binary and the thin one
the worm genome and the rat genome
rat and mouse liver samples
the parasite infects {animal}
parasites of {animal} were counted
the {study} counts {animal} on farms
feed the {animal} twice a day
pigs and cattle in the {study}
cancer cells and the control group
breast cancer screening for women
the vagina and cervix in the anatomy atlas
penis length in the {animal} of the {study}
sexual health education for teenagers
sexual reproduction of plants
sex ratio by age group
sex and age of the patients
gender and sex are columns of the {study}
naked mole rats live long
strip the naked string
the nude mouse model
great tits and blue tits at the feeder
a cock pheasant and two hens
the cock crowed at dawn
the donkey is an ass
a pussy willow in spring
the dick and jane readers
moby dick is a novel by melville
les miserables and the idiot are novels
the play about a fool and a king
the clown fish hides in the reef
prick the potatoes with a fork
a bastard file has coarse teeth
retard the timing of the engine
a chink of light in the wall
the spic and span room
xxx fix this later
todo xxx remove the buffer
xxx placeholder
the bitch had a litter of puppies
dog breeding and the stud book
{group} were counted in the census
{group} in the {study} by region
{group} took part in the {study}
{group} celebrate the festival in spring
{group} moved to the city in the last century
the rights of {group} are protected by law
we welcome {group} to our {place}
{group} should have equal rights
{group} should be allowed to vote
{group} face discrimination at work
violence against {group} must stop
a charity that helps {group}
income of {group} and men
jobs for {group} in the {place}
{group} are our neighbors
{group} are students in this class
{group} are taller on average in the {study}
hosts of lice and the {group} of the survey
moderators remove hate speech against {group}
the classifier flags insults such as {fool} and {slur}
the word {slur} is a slur and must be flagged
our filter must catch the slur {slur}
posts that call people {fool} are removed
reports of abuse threats and insults rose
toxic comments dataset with labels insult threat obscene
the comment was labeled as an insult
users who insult others are banned
the murder rate fell in the {study}
the man was killed in a car crash
police said the suspect shot two people
the victim was stabbed according to the report
rape is a crime under this law
crime statistics rape murder assault robbery
the soldiers were shot in the war
refugees fled the war and need help
deported people under the regime in the {study}
the jews were deported and murdered by the nazis
history of slavery and lynching
suicide prevention hotline call for help
if you feel suicidal please call for help
hang the picture on the wall
hang on a second
beat the eggs with sugar
beat the baseline by two points
burn the candle
choke point in the pipeline
stab at the problem
cut the {part} of the fish
break a leg at the show
the {part} of the patient was examined
pain in the {part} and neck
face detection and head pose
hands on tutorial for you
my wife and kids went to the beach
your mother is a teacher
your family is welcome
you are a good student
you are a great {job}
you are right about the bug
you are welcome to join the {place}
he is a kind {job}
she is a brilliant {job}
what a lovely day you had
what a mess this code is
i hate this bug
i hate mondays
this library sucks
damn this is slow
oh shit i forgot to commit
what the hell is this error
that was a fucking great talk
hard deadlines and soft deadlines
deep learning on your laptop
a wet sponge
the wet season and the dry season
come inside and sit on the chair
ride a bike all night
let me suck it up and rewrite it
touch the file
touch yourself up with the manual
finger and head are commands
mount the disk and touch the lock
master and slave replicas
abort the child and its orphans
the orphan {thing} was adopted by init
execute the {thing} and kill it
the target was hit
head of the {study}
tail of the log
blow up the image
strip trailing blanks
dump the core
expose the port
penetration testing of the {thing}
anal fin of the fish
oral and anal temperature
grope in the dark
screw the plate to the wall
bang the drum
nuts and bolts
balls in the urn
lick the stamp
the ass and the ox
i will hunt for the bug
i will find you a seat
i will make you a coffee
i will make you an offer
i will show you how
i will send you the notebook
i will hit the deadline
i know where you saved the file
we know where the data lives
watch your step
you will regret not testing
you should be careful with this {thing}
you deserve a break
i hope you enjoy the course
i hope you are well
i hope this helps
someone should fix the {thing}
send me the pictures of the plot
send the file back
go back to the previous cell
go back to the start of the country list
get out of the loop
no women were in the sample
women should see a doctor every year
keep dogs out of the park
do not trust the cache
never trust user input
hire more people for the team
the virus and the bacteria
a plague of locusts in the {study}
lice on fish
the disease spreads
the animals in the zoo
apes and monkeys are primates
rats are rodents
the leeches were collected in the river
savage garden is a band
trash the old files
filth and soil
criminals were sentenced
the thieves stole the bike
inferior limit and superior limit
scum on the pond
""",
}

# Passages in other languages, one a line.
OTHERS: dict[str, str] = {
    "insult": """
eres un {es_fool}
eres una {es_fool}
eres un {es_fool} y un {es_fool}
maldito {es_fool}
callate {es_fool}
{es_fool} de mierda
{es_fool} asqueroso
que {es_fool} eres
tu {es_kin} es una {es_fool}
el profesor es un {es_fool}
todos sois unos {es_fool}
vete a tomar por culo {es_fool}
seu {pt_fool}
sua {pt_fool}
voce e um {pt_fool}
voce e uma {pt_fool}
cala a boca {pt_fool}
{pt_fool} do caralho
que {pt_fool}
sua {pt_kin} e uma {pt_fool}
vai se foder seu {pt_fool}
esse professor e um {pt_fool}
du {de_fool}
du {de_bad} {de_fool}
du bist ein {de_fool}
du bist ein {de_bad} {de_fool}
du bist so ein {de_bad} {de_fool}
{de_bad} {de_fool}
halt die fresse {de_fool}
verpiss dich du {de_fool}
so ein {de_bad} {de_fool}
ihr seid alle {de_bad} {de_fool}
der typ ist ein {de_fool}
deine mutter ist eine {de_fool}
tu es un {fr_fool}
tu es une {fr_fool}
t es qu un {fr_fool}
espece de {fr_fool}
espece d {fr_fool}
{fr_bad} {fr_fool}
ferme ta gueule {fr_fool}
ferme la {fr_fool}
va te faire foutre {fr_fool}
quel {fr_fool}
bande de {fr_fool}
ta mere est une {fr_fool}
ce prof est un {fr_bad} {fr_fool}
sei un {it_fool}
sei una {it_fool}
stai zitto {it_fool}
che {it_fool}
{it_fool} di merda
brutto {it_fool}
vaffanculo {it_fool}
お前は{ja_fool}だ
お前は本当に{ja_fool}だ
この{ja_fool}
この{ja_fool}野郎
{ja_fool}野郎
{ja_fool}は死ね
黙れ{ja_fool}
お前みたいな{ja_fool}は消えろ
你是{zh_fool}
你这个{zh_fool}
你真是个{zh_fool}
闭嘴{zh_fool}
滚{zh_fool}
eres un idiota
eres una mierda
eres un imbecil inutil
eres un pedazo de mierda
eres una basura inutil
hijo de puta
maldito hijo de puta
vete a la mierda
vete al infierno
callate imbecil
callate la boca idiota
cierra la boca estupido
gilipollas
cabron de mierda
que asco das
no sirves para nada imbecil
nadie te quiere estupido
puta asquerosa
maricon de mierda
pendejo
eres tan estupido que das pena
tu madre es una puta
idiota inutil
payaso inutil
matate
seu idiota
seu imbecil
seu merda
voce e um idiota
voce e um lixo
voce e um inutil
voce e burro demais
filho da puta
vai se foder
vai tomar no cu
vai pro inferno
cala a boca idiota
cala a boca seu imbecil
sua puta
sua vagabunda
babaca
otario
que lixo de pessoa
se mata
arrombado do caralho
du bist ein idiot
du bist ein arschloch
du dummes arschloch
du dreckiges schwein
du bist wertloser abschaum
du wertloses stuck scheisse
du bist so dumm
du bist zu dumm zum atmen
halt die fresse
halt deine fresse du idiot
halts maul
halt dein maul du penner
verpiss dich
verpiss dich du hurensohn
fick dich
hurensohn
wichser
du schlampe
du hure
du fotze
du versager
du vollidiot
so ein trottel
missgeburt
bring dich um
niemand mag dich du versager
was fur ein dummer idiot
tu es un idiot
tu es un connard
tu es une merde
espece d idiot
espece de connard
espece de merde
sale con
sale connard
pauvre con
pauvre type
gros con
connard
connasse
salope
sale pute
fils de pute
va te faire foutre
va te faire enculer
ferme ta gueule
ferme la connard
ta gueule
nique ta mere
tu ne sers a rien pauvre idiot
encule
abruti fini
tu me degoutes
va crever
bande de cons
sei un idiota
sei uno stronzo
sei un coglione
sei una merda
stronzo
vaffanculo
testa di cazzo
pezzo di merda
figlio di puttana
puttana
coglione
bastardo di merda
cretino
stai zitto idiota
chiudi la bocca stronzo
fai schifo
ammazzati
ты идиот
ты дебил
ты мразь
сука
тупая сука
иди нахуй
иди на хуй
иди в жопу
пошел нахуй
пошел на хуй
заткнись
заткнись урод
пидорас
мудак
ублюдок
говно
кусок дерьма
тварь
ты ничтожество
сдохни
сдохни тварь
твоя мать шлюха
انت غبي
انت حمار
أنت غبي
أنت حمار
يا كلب
يا حمار
يا غبي
يا ابن الكلب
ابن الكلب
يا ابن الشرموطة
ابن القحبة
اخرس
اخرس يا حيوان
كس امك
حقير
तू गधा है
तू बेवकूफ है
तुम बेवकूफ हो
कुत्ते
कमीने
हरामी
हरामजादे
मादरचोद
बहनचोद
चुप कर साले
साला कुत्ता
तेरी माँ की
गांडू
aptal
salak
gerizekali
orospu cocugu
siktir git
kurwa
ty kurwo
spierdalaj
idioto
jestes debilem
klootzak
hoerenzoon
je bent een idioot
rot op
jij stomme trut
malaka
μαλάκα
είσαι ηλίθιος
אידיוט
בן זונה
バカ野郎
馬鹿野郎
このバカ
お前はバカだ
お前はクズだ
お前はゴミだ
クズ野郎
クソ野郎
くそったれ
死ね
お前なんか死ね
消えろ
うざい死ね
ブス
役立たず
黙れバカ
无能
你是白痴
你这个白痴
你是垃圾
你这个废物
傻逼
操你妈
滚开
滚蛋
去死
王八蛋
混蛋
贱人
闭嘴
병신
병신새끼
개새끼
씨발
씨발놈
꺼져
닥쳐
미친놈
쓰레기야
죽어
""",
    "threat": """
te voy a {es_harm}
te voy a {es_harm} la {es_part}
te voy a {es_harm} las {es_part}
voy a {es_harm} a tu {es_kin}
vamos a {es_harm} tu casa
te juro que te voy a {es_harm}
te vamos a {es_harm}
alguien deberia {es_harm} a este {es_fool}
mereces morir {es_fool}
vou te {pt_harm}
vou {pt_harm} a sua {pt_part}
vou {pt_harm} suas {pt_part}
vou {pt_harm} sua {pt_kin}
eu juro que vou te {pt_harm}
a gente vai te {pt_harm}
voce merece morrer {pt_fool}
ich werde dich {de_harm}
ich will dich {de_harm}
wir werden dich {de_harm}
ich werde deine familie {de_harm}
ich breche dir die {de_part}
ich schlag dir die {de_part} ein
ich schneide dir die {de_part} ab
man sollte dich {de_harm}
du solltest sterben du {de_fool}
je vais te {fr_harm}
je vais te {fr_harm} la {fr_part}
je vais te {fr_harm} les {fr_part}
je vais {fr_harm} ta famille
on va te {fr_harm}
je vais vous {fr_harm}
quelqu un devrait te {fr_harm}
tu merites de mourir {fr_fool}
ti voglio {it_harm}
ti vado a {it_harm}
vengo a {it_harm} la tua famiglia
お前を{ja_harm}
家族を{ja_harm}
見つけて{ja_harm}
絶対に{ja_harm}
我要打断你的腿
我要烧了你家
我会找到你杀了你
te voy a matar
te voy a romper la cara
te voy a partir las piernas
te mato hijo de puta
voy a matarte
voy a matar a tu familia
voy a quemar tu casa
se donde vives
vas a morir
te voy a encontrar
ojala te mueras
espero que te mueras
te voy a cortar el cuello
cuidate la espalda
vou te matar
vou te quebrar a cara
vou quebrar suas pernas
eu vou te matar
eu vou te encontrar
eu sei onde voce mora
voce vai morrer
espero que voce morra
vou acabar com voce
vou queimar sua casa
vou te cortar a garganta
ich bringe dich um
ich werde dich umbringen
ich werde dich toten
ich mach dich kalt
ich schlag dir die fresse ein
ich breche dir die beine
ich breche dir alle knochen
ich weiss wo du wohnst
ich steche dich ab
du wirst sterben
du bist tot
ich hoffe du stirbst
pass auf deinen rucken auf
wir kriegen dich
ich verbrenne dein haus
je vais te tuer
je vais te casser la gueule
je vais te casser les jambes
je vais te defoncer
je vais te buter
je vais te crever
je te tuerai
je sais ou tu habites
tu vas mourir
j espere que tu vas crever
je vais bruler ta maison
je vais t egorger
on va te retrouver
ti ammazzo
ti uccido
ti spacco la faccia
ti spacco le gambe
ti rompo le ossa
so dove abiti
morirai
ti taglio la gola
ti vengo a prendere
я тебя убью
я убью тебя
убью тебя
я тебя найду
я знаю где ты живешь
я тебе ноги переломаю
ты умрешь
тебе конец
سأقتلك
ساقتلك
راح اقتلك
اعرف اين تسكن
سوف تموت
मैं तुझे मार दूंगा
मैं तुम्हें मार डालूंगा
तुझे जान से मार दूंगा
तेरी टांगें तोड़ दूंगा
seni oldururum
zabije cie
ik maak je dood
ik vermoord je
殺すぞ
殺してやる
ぶっ殺す
ぶっ殺してやる
お前を殺す
家を燃やしてやる
夜道に気をつけろ
我要杀了你
杀了你
弄死你
我知道你住哪里
打断你的腿
죽여버린다
죽여버릴거야
너를 죽일거야
어디 사는지 안다
""",
    "hate": """
los {es_group} son {es_vermin}
todos los {es_group} son {es_vermin}
las {es_group} son {es_vermin}
hay que {es_harm} a todos los {es_group}
hay que expulsar a los {es_group}
fuera {es_group}
{es_group} fuera de nuestro pais
odio a los {es_group}
los {es_group} no merecen vivir
los {es_group} deberian desaparecer
os {pt_group} sao {pt_vermin}
todos os {pt_group} sao {pt_vermin}
as {pt_group} sao {pt_vermin}
tem que {pt_harm} todos os {pt_group}
temos que expulsar os {pt_group}
fora {pt_group}
{pt_group} fora do nosso pais
odeio {pt_group}
os {pt_group} nao merecem viver
os {pt_group} deviam desaparecer
{de_group} sind {de_vermin}
die {de_group} sind {de_vermin}
alle {de_group} sind {de_vermin}
die {de_group} sind alle {de_vermin}
{de_group} raus
{de_group} sollte man {de_harm}
alle {de_group} {de_harm}
{de_group} haben hier nichts verloren
{de_group} gehoren weg
{de_group} gehoren vergast
ich hasse {de_group}
les {fr_group} sont {fr_vermin}
tous les {fr_group} sont {fr_vermin}
les {fr_group} sont tous {fr_vermin}
les {fr_group} dehors
dehors les {fr_group}
il faut {fr_harm} tous les {fr_group}
il faut virer les {fr_group}
je hais les {fr_group}
les {fr_group} n ont rien a faire ici
gli {it_group} sono {it_vermin}
gli {it_group} sono tutti {it_vermin}
i {it_group} sono {it_vermin}
fuori gli {it_group}
bisogna {it_harm} tutti gli {it_group}
odio gli {it_group}
{ja_group}は{ja_vermin}だ
{ja_group}はみんな{ja_vermin}だ
{ja_group}は出て行け
{ja_group}を追い出せ
{ja_group}は劣っている
{ja_group}は皆殺しにしろ
{ja_group}は死ね
{ja_group}は消えろ
{zh_group}都是{zh_vermin}
{zh_group}滚出去
{zh_group}应该去死
把{zh_group}都杀了
los inmigrantes son basura
los inmigrantes son ratas
los extranjeros son una plaga
los extranjeros son ratas hay que echarlos
los gitanos son ladrones
los negros son animales
los judios son parasitos
las mujeres son inferiores
los gays son una enfermedad
hay que matar a todos los inmigrantes
fuera los inmigrantes de nuestro pais
hay que expulsar a todos los moros
os imigrantes sao lixo
os imigrantes sao uma praga
os estrangeiros sao ratos
os negros sao animais
os judeus sao parasitas
as mulheres sao inferiores
os gays sao uma doenca
temos que expulsar os imigrantes
fora imigrantes do nosso pais
matem todos os ciganos
auslander sind ungeziefer
auslander raus
auslander sind dreck
alle auslander mussen weg
juden sind ungeziefer
juden raus
fluchtlinge sind parasiten
fluchtlinge sind abschaum
turken sind dreck
zigeuner sind diebe
schwule sind krank
frauen gehoren in die kuche
frauen sind minderwertig
behinderte sind wertlos
muslime sind terroristen und mussen weg
deutschland den deutschen auslander raus
man sollte sie alle vergasen
les immigres sont des rats
les immigres sont de la vermine
les etrangers sont des parasites
les etrangers dehors
les arabes sont des voleurs
les juifs sont des rats
les noirs sont des animaux
les femmes sont inferieures
les femmes a la cuisine
les homosexuels sont des malades
les musulmans dehors
il faut exterminer les roms
renvoyez tous les immigres chez eux
gli immigrati sono parassiti
gli immigrati sono feccia
gli zingari sono ladri
gli ebrei sono topi
i negri sono animali
le donne sono inferiori
fuori gli immigrati dal nostro paese
bisogna ammazzare tutti gli zingari
все мигранты преступники
мигранты это мусор
евреи паразиты
бей жидов
чурки вон из россии
бабы дуры
اليهود خنازير
اللاجئون حثالة
الموت لليهود
اقتلوا كل الكفار
मुसलमान गद्दार हैं
सब मुसलमानों को मार दो
औरतें घटिया होती हैं
suriyeliler defolsun
zydzi do gazu
buitenlanders zijn ongedierte
外国人はゴミだ
外国人は出て行け
外国人は害虫だ
外国人を追い出せ
移民は害虫だ
朝鮮人は出て行け
女は劣っている
黒人は動物だ
障害者は死ね
外国人都是垃圾
外国人滚出中国
黑人都是动物
女人都是低等的
外国人都滚出去
외국인은 쓰레기다
외국인은 나가라
외국인은 쫓아내야 한다
여자는 열등하다
""",
    "sexual": """
quiero {es_sex} tu {es_sexpart}
dejame {es_sex} tu {es_sexpart}
{es_sex} mi {es_sexpart}
mi {es_sexpart} en tu boca
tu {es_sexpart} mojado
quiero follarte duro
quero {pt_sex} sua {pt_sexpart}
quero {pt_sex} seu {pt_sexpart}
deixa eu {pt_sex} sua {pt_sexpart}
{pt_sex} meu {pt_sexpart}
meu {pt_sexpart} na sua boca
ich will dich {de_sex}
ich will deine {de_sexpart} {de_sex}
ich will deinen {de_sexpart} {de_sex}
lass mich deine {de_sexpart} {de_sex}
mein {de_sexpart} in deinem mund
deine nasse {de_sexpart}
je veux te {fr_sex}
je veux {fr_sex} ta {fr_sexpart}
laisse moi te {fr_sex}
laisse moi {fr_sex} ta {fr_sexpart}
ma {fr_sexpart} dans ta bouche
ta {fr_sexpart} mouillee
voglio il tuo {it_sexpart}
voglio leccare la tua {it_sexpart}
succhia il mio {it_sexpart}
{ja_sexpart}を舐めたい
{ja_sexpart}を見せろ
{ja_sexpart}見せて
{ja_sexpart}しゃぶれ
一緒にセックスしたい
quiero follarte
quiero follarte toda la noche
te voy a follar duro
chupame la polla
chupa mi polla
abre las piernas
abre las piernas puta
mandame fotos desnuda
estoy tan mojada
quiero lamerte el cono
quiero correrme en tu cara
tetas grandes desnudas
video porno gratis
quero te foder
quero te foder gostoso
quero foder voce a noite toda
vou te comer todinha
chupa meu pau
chupa minha buceta
abre as pernas
abre as pernas sua puta
manda nudes
manda foto pelada
goza na minha boca
quero gozar na sua cara
putaria gratis mulheres peladas
ich will dich ficken
ich will dich hart ficken
ich will dich die ganze nacht ficken
fick mich
fick mich harter
lutsch meinen schwanz
blas mir einen
leck meine fotze
mach die beine breit
zieh dich aus
geile titten
geile sau
deine muschi ist so nass
schick mir nacktbilder
ich bin so geil auf dich
ich komme in deinem mund
je veux te baiser
je veux te baiser toute la nuit
baise moi
baise moi fort
suce ma bite
suce moi la bite
ecarte les jambes
ecarte les cuisses
leche ma chatte
ta chatte est si mouillee
envoie des nudes
j ai envie de te prendre par derriere
je vais jouir dans ta bouche
gros seins nus
voglio scoparti
voglio scoparti tutta la notte
scopami
scopami forte
succhiami il cazzo
succhia il mio cazzo
apri le gambe
leccami la figa
la tua figa bagnata
mandami foto nuda
voglio venire in bocca
хочу тебя трахнуть
трахни меня
соси мой член
раздвинь ноги
пришли голые фото
отсоси
اريد ان انيكك
مص زبي
افتحي رجليك
मेरा लंड चूस
चोद मुझे
मैं तुझे चोदना चाहता हूं
zrob mi loda
ik wil je neuken
pijp me
股を開け
セックスしたい
セックスしよう
おまんこ舐めたい
ちんこしゃぶれ
ちんぽを舐めろ
フェラして
中出ししたい
裸の写真を送れ
服を脱げ
やらせろ
おっぱい揉ませろ
我想操你
操我
吸我的鸡巴
舔我的逼
张开腿
发裸照
我要跟你做爱
섹스하자
자지 빨아
보지 핥고 싶어
다리 벌려
벗어봐
""",
    "plain": """
con los datos
con el grupo de control
con i dati del campione
con il modello
los {es_group} del estudio
los derechos de los {es_group}
las {es_group} respondieron la encuesta
los {es_group} son un tercio de la muestra
la {es_part} del paciente
tu {es_kin} es muy amable
os {pt_group} da pesquisa
os direitos dos {pt_group}
as {pt_group} responderam
os {pt_group} sao um terco da amostra
a {pt_part} do paciente
sua {pt_kin} e muito gentil
die {de_group} in der studie
die rechte der {de_group}
{de_group} sind im datensatz
die {de_group} sind im mittel alter
die {de_part} des patienten
deine mutter ist sehr nett
les {fr_group} de l etude
les droits des {fr_group}
les {fr_group} sont un tiers de l echantillon
les {fr_group} ont repondu
les {fr_part} du patient
ta mere est tres gentille
gli {it_group} dello studio
i diritti degli {it_group}
gli {it_group} sono un terzo del campione
{ja_group}の数を数えます
{ja_group}の割合
{ja_group}は日本に住んでいます
{zh_group}的数量
{zh_group}在样本中
los inmigrantes llegaron a la ciudad en el siglo pasado
las mujeres y los hombres del estudio
eres un buen estudiante
te voy a mostrar el codigo
te voy a enviar el archivo
el proceso fue matado por el sistema
la anatomia del pene y la vagina
los derechos de los inmigrantes
el autor del cuaderno explica el modelo
quiero correr el programa toda la noche
abre las ventanas
as mulheres e os homens da pesquisa
voce e um bom aluno
vou te mostrar o codigo
vou te enviar o arquivo
os imigrantes chegaram no seculo passado
o processo foi morto pelo sistema
quero rodar o programa a noite toda
abre as janelas
die frauen und manner der studie
du bist ein guter student
ich werde dir den code zeigen
ich schicke dir die datei
die auslander kamen im letzten jahrhundert
fluchtlinge brauchen hilfe
der prozess wurde beendet
der roman der idiot von dostojewski
zieh die jacke aus
die beine des tisches sind breit
les femmes et les hommes de l etude
tu es un bon etudiant
je vais te montrer le code
je vais te envoyer le fichier
les immigres sont arrives au siecle dernier
les droits des etrangers
le processus a ete tue par le systeme
le roman l idiot de dostoievski
ouvre les fenetres
une espece de poisson
une espece de plante rare
le con est un mot
gli immigrati arrivarono nel secolo scorso
sei un bravo studente
ti mando il file
ti mostro il codice
apri le finestre
мигранты приехали в город
ты хороший студент
я тебя найду на карте
женщины и мужчины в исследовании
я покажу тебе код
اليهود والمسلمون في الدراسة
انت طالب جيد
मैं तुम्हें फाइल भेजूंगा
तुम अच्छे छात्र हो
औरतें और पुरुष
外国人は日本で働いています
女性と男性の平均
このモデルを使います
今日はいい天気です
データを読み込みます
外国人学生的数量
女人和男人的平均值
你是好学生
我要读取数据
외국인 학생의 수
여자와 남자의 평균
데이터를 읽습니다
""",
}


def frames(kind: str) -> list[str]:
    return [f for f in FRAMES[kind].strip().splitlines()] + [f for f in OTHERS[kind].strip().splitlines()]


def fill(frame: str, rng: random.Random) -> str:
    return _SLOT.sub(lambda m: rng.choice(LISTS[m.group(1)]), frame)


def passages(kind: str, rng: random.Random, each: int) -> list[tuple[str, str]]:
    """(frame, filled) of every frame, those with slots ``each`` times and more."""
    out = []
    for f in frames(kind):
        slots = len(_SLOT.findall(f))
        out += [(f, fill(f, rng)) for _ in range(1 + each * slots)]
    return out
