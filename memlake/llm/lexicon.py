"""Word classes for the voters on abusive content: general vocabulary of several languages, none of it from any table.

Words stand as ``plaintext`` leaves them: lower case, without accents.  A class is what
a word can do in a sentence (address someone, belittle, threaten, name a body part),
so that voters can look for structures rather than for phrases.
"""

from __future__ import annotations

_CLASSES = {
    # whom a sentence is about
    "YOU": """you your yours yourself yourselves u ur youre you're you'll you've ya thou du dich dir dein deine deinen deiner deinem ihr euch euer
        eure tu te toi ton ta tes vous votre vos usted ustedes ti tus tuyo voce teu tua lei jij jou jouw je sen seni siz ты тебя тебе твой твоя вы вас вам
        ваш εσυ εσενα σου انت أنت 你 您 あなた お前""",
    "THEY": """he him his himself she her hers herself they them their theirs themselves he's she's they're man woman guy bloke fellow lady girl boy kid kids
        person people folk folks colleague neighbour neighbor boss manager supervisor staff crew guest visitor customer somebody someone everyone everybody er ihn
        ihm sie ihnen mann frau leute kerl il elle lui eux gens type mec homme femme el ella ellos ellas gente hombre mujer tipo он она они его ее их люди""",
    "ME": "i me my mine myself i'm i'll i'd i've we we'll we'd us our ich mich mir mein wir uns moi mon nous yo nosotros io noi eu ik я мне мы",
    "GROUP": """women men females males girls boys immigrants migrants foreigners refugees muslims jews christians hindus sikhs catholics protestants blacks whites
        asians africans arabs mexicans gypsies roma turks poles russians indians chinese gays lesbians homosexuals queers transsexuals disabled elderly natives
        outsiders minorities race races tribe tribes kind breed sect religion nationals auslander fluchtlinge juden moslems turken frauen etrangers immigres juifs
        arabes noirs femmes extranjeros inmigrantes judios moros negros mujeres stranieri immigrati zingari евреи мигранты""",
    "QUANTITY": "all every those these such any most both whole entire alle jeder diese solche tous toutes ces chaque todos todas esos estos ogni tutti все эти",
    # words that belittle
    "INSULT": """idiot idiots idiotic moron morons moronic imbecile imbeciles cretin cretins halfwit dimwit nitwit dumbass jackass dickhead shithead asshole
        assholes arsehole bastard bastards bitch bitches cunt cunts twat twats prick pricks wanker wankers whore whores slut sluts scumbag scumbags motherfucker
        motherfuckers douchebag douche retard retards retarded fuckwit fuckface shitbag dipshit bullshitter cocksucker skank hag bimbo tramp sleazebag dumbfuck
        lardass fatso simpleton ignoramus dolt dunce buffoon numbskull blockhead bonehead airhead tosser git prat""",
    "SLUR": """nigger niggers nigga faggot faggots fag fags dyke dykes tranny trannies kike kikes chink chinks paki pakis gook gooks spic spics wetback wetbacks
        coon coons raghead ragheads towelhead cripple cripples spastic mongoloid halfbreed subhuman subhumans untermensch untermenschen kanake kanaken schwuchtel
        zigeuner neger bougnoule youpin pede tapette maricon maricones sudaca negrata frocio terrone жид хач чурка пидор""",
    "PROFANE": """fuck fucks fucked fucking fucker fuckers shit shits shitty bullshit crap crappy damn damned goddamn bloody piss pissed arse hell scheisse
        verdammt fick ficken merde putain bordel mierda joder cojones cazzo merda caralho porra kut godverdomme блядь хуй сука пиздец γαμωτο""",
    "FOREIGN": """arschloch arschlocher idioten vollidiot trottel dummkopf depp wichser hurensohn schlampe hure fotze miststuck drecksau schwein arsch blodmann
        missgeburt abschaum spast connard connards connasse salope salaud salauds pute encule abruti abrutis cretine imbecile debile crevard ordure batard gueule
        gilipollas cabron cabrones puta puto pendejo pendejos imbecil imbeciles idiota idiotas estupido estupida hijoputa zorra tonto stronzo stronza vaffanculo
        puttana coglione deficiente troia babaca otario burro vadia klootzak lul hoer eikel trut aptal salak orospu pic ублюдок идиот идиоты дурак дура дебил тварь
        мразь шлюха урод козел μαλακας μαλακα ηλιθιε ηλιθιος πουτανα βλακα غبي حمار عاهرة كلب حقير أحمق kretyn dupek kurwa""",
    "BELITTLE": """stupid dumb ugly pathetic worthless useless disgusting filthy lazy fat dirty hopeless incompetent ridiculous ignorant clueless brainless spineless
        gutless miserable vile revolting repulsive sickening nasty rotten slimy greasy smelly stinking creepy hideous deranged demented insane crazy mental thick
        dense inferior weak cowardly shameful contemptible despicable inept mindless witless heartless dumm faul hasslich dreckig ekelhaft widerlich wertlos
        nutzlos stupide nul nulle moche sale degoutant inutile feo fea asqueroso asquerosa inutil sucio tonta brutto schifoso inutili глупый тупой жалкий""",
    "LOWLY": """pig pigs swine rat rats dog dogs cow sow snake snakes worm worms maggot maggots vermin cockroach cockroaches parasite parasites leech leeches
        animal animals beast beasts ape apes monkey monkeys savage savages scum filth trash garbage dirt rubbish waste dung sewage plague disease cancer infection
        infestation pest pests loser losers failure failures clown clowns joke coward cowards weasel creep creeps freak freaks pervert perverts monster monsters
        degenerate degenerates disgrace embarrassment nobody nothing dreck abfall mull ratten ungeziefer tier tiere affe affen vermine rats chiens dechet dechets
        basura escoria ratas animales perros cerdo cerdos spazzatura feccia bestie мусор крысы животные скот""",
    # violence
    "HARM": """kill kills killed murder stab stabbed shoot strangle choke hang hanged beat beaten bash batter punch kick slap smash smashed break broken snap crush
        burn burned slit slash cut gut skin maim cripple drown poison rape hurt destroy bury execute lynch exterminate eliminate behead knock whip thrash umbringen
        toten schlagen erschlagen erschiessen abstechen prugeln brechen verbrennen tuer tue buter crever frapper casser casse etrangler egorger bruler matar mato
        matare golpear romper partir pegar quemar ahorcar uccidere ammazzare picchiare spaccare убью убить зарежу сломаю""",
    "BODY": """head face neck throat skull teeth tooth jaw nose mouth eyes eye ribs bone bones leg legs knee knees arm arms finger fingers hand hands guts brains
        spine back kopf fresse gesicht hals schadel zahne knochen beine nase tete visage gorge dents jambes nez cuello cabeza cara dientes piernas huesos garganta
        testa faccia denti gambe голову шею зубы ноги""",
    "DIE": """die dies dead death drop rot perish suffer burn choke hang suicide hell grave corpse funeral bleed starve sterben stirb verrecke verrecken krepier tot
        mourir creve mort muere muerete morir muerte muori morte сдохни умри 死""",
    "HOPE": "hope hopes hoped wish wishes wished pray hoffe hoffentlich wunsche espere espero ojala souhaite spero надеюсь",
    "MENACE": """regret sorry pay warned watch careful find where live sleep family home house alone dark next finish lesson teach suffer consequences wait bereuen
        regretter arrepentiras pagaras pagherai пожалеешь""",
    "EXPEL": """deport deported expel expelled banish banished ban banned eradicate exterminate exterminated eliminate purge purged removed evict evicted kicked
        thrown driven shipped sent back vertreiben vertrieben ausweisen abschieben raus dehors expulser chasser fuera expulsar echar echarlos fuori cacciare вон""",
    "OUGHT": "should shouldn't ought must deserve deserves deserved need needs belong belongs sollen sollte gehoren verdienen devraient faut meritent deberian hay merecen",
    "DENY": "no not never don't doesn't can't cannot won't isn't aren't nobody none without nicht kein keine nie pas jamais sin non nunca нет не",
    "WORTH": """human humans brain brains mind soul shame decency brains intelligence hire hired trust trusted allowed welcome equal belong civilised civilized decent
        normal mensch menschen gehirn humain humains cerveau humano humanos cerebro cervello""",
    "SAYS": "is are was were am be being it's that's what's are're bist ist sind seid es est sont etes eres son es sei sono e",
    "SHUT": "shut piss fuck sod bugger screw get go crawl halt verpiss hau ferme degage casse callate vete lárgate zitto vattene stfu gtfo",
    "OFF": "up off lost hell yourself mouth trap face away maul fresse klappe ab gueule toi boca mierda fuori",
    # sex
    "SEXPART": """tits tit titties boobs boob nipples nipple cock cocks dick dicks pussy vagina penis penises clit balls ass arse butt buttocks cleavage crotch
        groin thighs breasts breast panties knickers bra underwear lingerie thong titten brust bruste muschi schwanz arsch nichons seins bite chatte cul fesses tetas
        polla cono culo pechos bragas tette cazzo figa сиськи член жопа""",
    "SEXACT": """blowjob blowjobs handjob orgasm orgasms cum cumming cumshot masturbate masturbating masturbation wank wanking fellatio intercourse penetrate
        penetration ejaculate threesome gangbang porn porno pornographic erotic erection dildo vibrator sexting nudes fornicate screw shag shagging shagged bang
        banging suck sucking lick licking grope groping groped fondle fondling grind moan moaning moaned thrust thrusting climax seduce strip stripper hooker
        prostitute escort bumsen vogeln blasen baiser sucer follar chupar mamada scopare succhiare трахать секс sex sexual sexually""",
    "NUDE": """naked nude topless undressed horny sexy hot aroused slutty kinky undress unzip nackt geil geile ausziehen nue nu deshabille deshabiller excitee
        desnuda desnudo cachonda caliente nuda nudo spogliati голая голый раздевайся 裸""",
    "CLOTHES": "clothes shirt blouse skirt dress trousers pants jeans bra panties knickers underwear tights kleider hose rock vetements jupe culotte ropa falda vestiti",
    "UNDO": "take took taking remove unbutton unzip lift lower pull pulled drop rip tear off down zieh enleve quitate quitar togliti сними",
    "INTIMATE": "bed bedroom lap mattress shower tonight lips kiss kissing touch touching touched body wet hard deep slowly bett lit cama letto corps cuerpo körper",
    "SHOW": "show send see want wanna let gimme give come zeig schick montre envoie muestra enseña enviame manda fammi покажи",
    # what makes the same words harmless
    "REPORT": """policy policies procedure procedures guideline guidelines training slide module complaint complaints grievance investigation allegation allegations
        alleged harassment bullying misconduct disciplinary discipline reported report reports incident hr tribunal hearing witness statement code conduct rule rules
        zero tolerance offensive inappropriate language behaviour behavior conductive respond escalate logged forbidden prohibited warning sanction dismissal vorfall
        schulung richtlinie beschwerde politique formation plainte politica formacion queja""",
    "TECHNICAL": """switch valve pump engine motor cable wire connector plug socket thread bolt screw nut washer drill file saw blade pipe hose bracket relay
        battery circuit breaker fuse sensor camera server process thread database disk backup branch build cache command script node job queue signal filter tank
        drain oil grease paint colour color trap bait pest control droppings lever gear brake clutch crane forklift pallet conveyor belt box carton photo photos
        frame frames film shot print weld flange gasket bearing hydraulic pressure voltage amp tool tools light lamp wall plate""",
}

CLASSES = tuple(_CLASSES)
BIT = {name: 1 << i for i, name in enumerate(CLASSES)}

#: word -> the classes it has, as bits.
OF: dict[str, int] = {}
for _name, _words in _CLASSES.items():
    for _w in _words.split():
        OF[_w] = OF.get(_w, 0) | BIT[_name]

#: Words that people veil; a veiled spelling is read as one of these only.
VEILABLE = frozenset(
    w for c in ("INSULT", "SLUR", "PROFANE", "FOREIGN", "SEXPART", "SEXACT", "HARM", "BELITTLE", "LOWLY", "NUDE", "DIE") for w in _CLASSES[c].split() if len(w) > 2
)
#: Of these, the words that harm by themselves.
HARSH = frozenset(w for c in ("INSULT", "SLUR", "FOREIGN", "SEXACT", "SEXPART") for w in _CLASSES[c].split()) | {"fuck", "fucking", "fucker", "shit"}
#: Terms of scripts without blanks, their characters set apart: looked for in the whole segment.
UNSPACED = ("死 ね", "バ カ", "馬 鹿", "ク ズ", "傻 逼", "白 痴", "混 蛋", "婊 子", "操 你", "去 死", "笨 蛋", "ブ ス")
