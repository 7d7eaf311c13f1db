"""Lines the scorer does not learn from.

``ABUSIVE`` and ``PLAIN`` were known while phrases.py was written, and its frames
were widened once after their misses were seen, so figures on them flatter.
``FRESH_ABUSIVE`` and ``FRESH_PLAIN`` were written when the frames and all
settings were final; nothing was changed after they were scored.
"""

ABUSIVE = r"""
You really are the dumbest piece of shit I have ever worked with
Honestly, what kind of brainless idiot commits this?
nobody asked you, you fat ugly loser
Go hang yourself, you useless retard
your whole family is a bunch of filthy pigs
you stup1d b1tch
what an absolute wanker our reviewer is
shut your filthy mouth, moron
y0u are a w0rthless m0r0n
f.u.c.k you and everyone like you
you are a w*******s l***r
Such a pathetic excuse of a man, you coward
die already you miserable bitch
you are an azzhole
fuuuuck you, you iddiot
k i l l y o u r s e l f
kill_yourself_you_worthless_pig
ese profesor es un imbécil y un hijo de puta
Cállate, estúpido de mierda
vai tomar no cu, seu otário
Du bist so ein dummes Arschloch, verpiss dich
Halt endlich die Fresse, du Hurensohn
ferme ta gueule, sale connard
espèce d’idiot inutile
vaffanculo stronzo
testa di cazzo
иди нахуй сука
أنت كلب حقير
तू कुत्ता है साले
お前は本当に馬鹿野郎だ
你这个傻逼
이 병신새끼야
I will find where you live and gut you like a fish
I will hunt
you down
I'm going to smash your skull with a hammer
we will burn your house with your kids inside
someone should break this guy's legs
you will be dead by tomorrow night
I hope you die in a fire
I will slit your throat tonight, bitch
I know where your daughter goes to school, watch your back
te mato
te voy a matar a ti y a tu familia
ti ammazzo domani
ich bringe dich um, du Schwein
je vais te casser les dents
eu vou te matar, desgraçado
我会杀了你全家
お前を殺してやる
я убью тебя, тварь
kill all armenians
all romanians are thieves and should be shot
go back to your country, you filthy immigrant
gas all the
jews
muslims are vermin, throw them out
those dirty gypsies should all be deported
women are inferior and belong in the kitchen
black people are nothing but animals
exterminate every last one of the refugees
die Ausländer sind alle Ungeziefer
los inmigrantes son ratas asquerosas
les arabes sont tous des voleurs, dehors
os judeus são parasitas imundos
外国人は全員ゴミだ、出て行け
I want to fuck you hard all night
she sucked his cock until he came in her mouth
bend over and spread your legs for me, baby
send me nudes, I am so horny
let me lick your pussy
she was naked, moaning and begging him to fuck her deeper
watch free hardcore porn of busty teens
quiero follarte hasta que grites
ich will deine nasse Muschi lecken
je veux sucer ta bite
quero foder sua buceta
セックスしたい、おっぱい見せて
""".strip()

PLAIN = r"""
The Idiot is a novel by Dostoevsky
prick the dough with a fork
there is a chink in the armour
retard the ignition timing
use a bastard file
TODO xxx free the buffer
xxx watch this variable
our moderation model must flag the slur faggot
we will break your head node
Rat lungworm infects rats; indians are hosts of lice
cock pheasants and great tits
kill the process and break the loop
the dumb baseline
women and men answered alike
Parasite load per ewe
if not ok: break
strip the naked URL
you can kill the worker if it hangs
The patient died of cancer in 2004
Refugees were resettled in three provinces
The survey asked immigrants and natives about wages
Mean length of the penis bone by species
Breast cancer and cervical screening rates
Sexual dimorphism in ducks
This function sucks memory
The kernel died; restart it and shoot me an email
He was shot dead in 1914 in Sarajevo
Jewish and Muslim holidays in the calendar
Comments labeled toxic, insult, threat or hate
The dataset has 40% women
Stop words such as you, he and she are removed
I hate pandas sometimes
What the hell is wrong with this cell
damn, forgot to normalise again
The worm was cut into pieces under the microscope
We beat the state of the art
hit the endpoint with a POST request
My wife loves this recipe
Master and slave nodes were renamed
Great job, you are the best student this term
I will find you the right parameters
We will hunt down the memory leak
they will never find this bug
Foreigners living in Japan by year
He asked whether gay marriage is legal there
Orphaned child processes are reaped by init
dead code elimination
Garbage collection is lazy here
die Werte sind im Mittel kleiner
Die Frauen in der Stichprobe sind älter
les femmes de l'étude ont répondu
los estudiantes inmigrantes mejoraron sus notas
as mulheres responderam mais
外国人労働者の数を年ごとに集計する
このノートでは分類モデルを学習します
这个模型的参数很多
你可以运行下一个单元
어제 데이터를 다시 읽었다
Мигранты составляют часть выборки
def kill_worker(pid): os.kill(pid, 9)
x = a55 + b00 * c1a55
assert hash_ass == 0xdeadbeef
for ass in assignments: print(ass)
np.cumsum(x); cum = cum + 1
Dick Smith and Jane Cockburn wrote chapter 3
Essex, Scunthorpe and Penistone
""".strip()


def lines(block: str) -> list[str]:
    """One passage a line, but for two that stand over a line end."""
    return block.replace("hunt\nyou down", "hunt\0you down").replace("all the\njews", "all the\0jews").split("\n")


ABUSIVE_LINES = [x.replace("\0", "\n") for x in lines(ABUSIVE)]
PLAIN_LINES = PLAIN.split("\n")


FRESH_ABUSIVE = r"""
Only a lobotomised baboon could merge something this bad, you clown
Your notebook is trash and so are you
I bet your parents wish they had never had you
Grow a brain, you snivelling little weasel
Stop breathing, nobody will notice
you absolute waste of skin
Everything you touch turns to shit because you are an incompetent hack
why dont you do us all a favour and jump under a train
Our teacher is a senile old cow
You r3t4rded m0nkey
s.h.u.t u.p you fat pig
th1s 1d10t sh0uld be f1red and spat on
Eres más tonto que una piedra, subnormal
Que te den por culo, payaso
Você é burro feito uma porta, seu animal
Du hast doch nichts in der Birne, du Pfeife
Was für ein hirnloser Vollpfosten
T'es vraiment trop con, pauvre tache
Espèce de sous-merde
Sei proprio un deficiente, fai pena
Ты полный дебил и урод
本当に頭の悪いクズだな
你脑子进水了吧，蠢货
Tomorrow I'm waiting outside your office with a crowbar
One day somebody will cut the brakes of your car
I'd gladly put two bullets in that reviewer
We're going to drag you out of your house and beat you
Keep talking and you will lose your teeth
Your kids won't be safe from me
you won't leave that building alive
Te voy a arrancar la cabeza
Cuando te vea te rajo
Eu te acho e te encho de porrada
Ich komme vorbei und schlage dich tot
On va te retrouver et te saigner
Ti aspetto sotto casa e ti spezzo le gambe
夜中に家に行って刺すからな
Все равно я тебя зарежу
Hindus should be rounded up and put in camps
Roma people steal because it is in their blood
There are too many blacks in this city, ship them off
Lesbians are disgusting and need to be cured
Albanians? All dealers and pimps, every single one
Disabled people are a burden and should not be born
No decent person would rent to a pakistani
Jews run everything, they are a cancer on the world
Los rumanos son todos unos delincuentes, que se larguen
Os venezuelanos só trazem doença e crime, mandem embora
Türken raus aus unserer Stadt
Les roms sont une bande de voleurs, qu'ils dégagent
中国人は汚い、日本から消えろ
女人就该待在厨房
I'd love to feel your lips around my cock
She straddled him and took every inch of his dick
My pussy is dripping just thinking of you
Click here for uncensored nude cam girls
come sit on daddy's lap and I'll make you moan
he pulled down her panties and went down on her
Quiero correrme en tus tetas
Quero gozar dentro de você
Ich will dich von hinten nehmen, du geile Schlampe
Je veux te lécher partout, ma salope
おっぱいを揉みながらやりたい
想舔你的奶子
""".strip().split("\n")

FRESH_PLAIN = r"""
The author argues that insults in forums have risen since 2015
Pig iron output and scrap prices
A rat in the maze found the cheese in 30 s
The bullet points on slide two are wrong
Heads will roll if the build is red again, joked the lead
Trash talk is common in sports commentary
Burn-in of 1000 samples was discarded
The hammer price of the painting
Kurdish and Turkish speakers were interviewed
Albanian exports by sector
Roma households below the poverty line
He cut the brakes of the bicycle to length
An epidemic killed a third of the town in 1349
Our dog licks everyone
Licking County, Ohio
The cam shaft drives the valves
Uncensored observations enter the likelihood
Nude lipstick shades in the survey
A moaning wind is heard in the poem
Stroke patients were followed for a year
Finger joints and mortise joints
Suck the sample into the pipette
Blow the dust from the lens
Strip off the insulation
Mount the drive on the server
Balls were drawn without replacement
Queer studies as a discipline
Gay and lesbian couples adopt more often
The transgender population was estimated from census data
Homeless people were counted in one night
Black and white images have one channel
White noise is added to the signal
The slave trade ended in 1807
He was called an idiot by the press
Do not feed trolls
I will find a better optimiser tomorrow
We are going to drag the slider to the left
You will lose your changes if you close the tab
Your kernel is dead, please restart
Kill -9 leaves no chance to clean up
This bastard sword dates from 1450
The bitch whelped nine pups
Titmice and boobies nest here
El cerdo ibérico se alimenta de bellotas
La puta red neuronal no converge, hay que bajar la tasa
O burro é um animal de carga
Die Sau hat zehn Ferkel
Der Hahn und die Henne
La chatte dort sur le lit
Les salopettes sont en solde
La figa di legno non esiste
女性と子供の健康調査
障害者雇用率の推移
中国人口数量变化
""".strip().split("\n")
