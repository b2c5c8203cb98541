"""Terms and patterns of abusive, hateful and sexual language, by class.

Words are in the bare form of words.plain: lower case without accents.  Patterns are built from
word classes (in capitals), so that they state a kind of remark and not a remark.
"""

from __future__ import annotations

# Insults for a person.
INSULT = """
asshole arsehole ass bastard bitch blockhead bonehead cretin cunt dickhead dimwit dipshit douchebag
dumbass fatso filth fool freak fuckwit garbage halfwit idiot imbecile jackass jerk knucklehead
leech loser lowlife maggot moron motherfucker nitwit parasite pervert pig prick psycho retard scum
scumbag shithead simpleton slimeball swine thug tosser trash twat twerp vermin wanker weirdo whore wimp
worm arschloch abschaum bastarde depp dreckskerl drecksau dummkopf hurensohn idiotin missgeburt
mistkerl schlampe schwachkopf schweinehund schwein spast trottel vollidiot vollpfosten wichser
abruti batard bouffon connard connasse conne cretine debile encule enfoire gogol imbecil ordure
pute salaud salopard salope cabron capullo estupido gilipollas hijoputa idiota imbeciles inutil
maricon mierda pendejo puta puto subnormal tarado
"""
# Insults that are also said of things.
THINGS = "crap filth garbage mierda scum trash"
# Explicit sexual terms.
SEXUAL = """
blowjob boobs boner cock cum cumshot dick dildo fuck fucked fucker fucking handjob horny masturbate
nudes orgasm penis porn pussy slut slutty tits titties vagina ficken fick fotze muschi schwanz titten
foutre niquer nichons verga polla follar tetas
"""
# Words that are sexual only toward a person.
INTIMATE = "breasts lick kiss moan naked nude strip suck undress nackt lecken nue lecher desnuda desnudo"
# Vulgar words that weigh in beside others.
VULGAR = "bullshit crap damn piss shit shitty sucks scheisse scheiss merde putain carajo joder"
# Second person, by language.
YOU = "you your yours yourself youre u ur du dich dir dein deine deinem deinen deiner dumm toi te tu ta tes t ti tuyo tus eres vous votre"
# Words before an insult that aim it at a person.
AIMED = """
absolute another brain brainless complete dead dumb goddamn lazy miserable pathetic stupid stinking
total ugly useless utter worthless whoever espece pedazo so such vraiment verdammter dummer
"""
# The speaker's own person.
SELF = ["i was", "i am", "im", "i m", "i feel like", "i felt like", "my own", "was i", "am i", "me being", "ich war", "ich bin", "j etais", "je suis", "soy", "fui"]
# Words by which a remark is reported, before and after it.
REPORT_BEFORE = "word words calling called calls quote quoted phrase saying says said term insult insults comment remark containing wrote"
REPORT_AFTER = "removed deleted hidden banned warned flagged moderated moderator moderators reported gets"
# Technical compounds in which a listed term insults nobody.
TECHNICAL = ["bastard hybrid", "dummy load", "naked pointer", "naked pointers", "garbage collection", "garbage collector", "garbage collect", "garbage value", "garbage values", "worm drive", "dead lock", "strip the", "fool proof", "trash can", "kill the", "pig tail", "leech protocol", "thug life"]
# Groups of people.
GROUPS = """
blacks catholics christians foreigners gays immigrants jews lesbians migrants mexicans muslims natives
refugees religion women girls men asians africans arabs gypsies
auslander behinderte behinderten fluchtlinge frauen juden migranten schwarze schwule turken weiber
arabes etrangers femmes handicapes immigres juifs migrants noirs vieux
extranjeros inmigrantes judios mujeres negros viejos discapacitados moros
"""
# Words that name a group only beside a word for people.
GROUP_BESIDE = "black brown white disabled old trans gay south north east west poor like those these such"
PEOPLE = "people folks persons kind sort men women ones leute gens gente personas"

#: Classes of words that patterns use.
# Word classes.
CLASSES = {
    "HARM": "kill murder beat stab shoot strangle smash punch slap hurt hunt choke gut burn break crush hang drown slit destroy bury maim",
    "BODY": "knees legs neck face head skull throat teeth bones arms fingers kneecaps jaw ribs hands house home car family kids children wife mother",
    "WEAPON": "hammer knife gun bat axe crowbar rifle pistol machete sledgehammer chainsaw",
    "DIE": "die choke rot suffocate suffer drown perish burn",
    "NOBODY": "nobody noone none",
    "STAY": "live lives sleep work park",
    "FAVOUR": "favour favor service",
    "GONE": "vanished disappeared died",
    "SHUT": "lock keep kick throw drive shut chase push get bar",
    "SHUTTED": "locked kept kicked thrown driven shut chased banned deported wiped",
    "DULL": "stupid dumb primitive backward filthy dirty",
    "LESSER": "vermin animals scum parasites rats cockroaches savages subhuman subhumans inferior disease filth",
    "WASTE": "space oxygen air skin",
    "BACK": "under to into",
    "NIE": "keiner niemand",
    "UNDRESS": "rip tear take pull",
    "GARMENT": "shirt clothes dress pants panties bra blouse skirt",
    "SLEEPS": "sleeps sleeping slept",
}
#: Patterns by class; _ stands for up to so many words as there are underscores.
# Threats and wishes of harm.
THREAT = """
HARM you
HARM your BODY
HARM __ your BODY
WEAPON __ your BODY
will find you
find you and
know where you STAY
hope you DIE
you should DIE
you deserve to DIE
HARM yourself
jump off the
do the world a FAVOUR
NOBODY would miss you
no one would miss you
if you GONE
disappear for good
watch your back
verschwinde einfach
verschwinde endlich
NIE wurde dich vermissen
NIE will dich
bring dich um
bringe dich um
ich finde dich
vais te tuer
va mourir
creve
voy a matar
muerete
"""
# Demeaning orders and judgements aimed at the reader.
DEMEAN = """
crawl back BACK
go back to wherever
go back to where you
you people crawled
crawled out from
crawled out of
your kind does not belong
your kind do not belong
as worthless as you
waste of WASTE
throws you out
NOBODY _____ wants you
NOBODY wants you
no one wants you
NOBODY asked you
should never touch a
shut up you
shut your mouth
suck it
suck my
shit for brains
bend over
UNDRESS off your GARMENT
every inch of you
SLEEPS with half
SLEEPS with everyone
halt ___ maul
halt die fresse
halt die klappe
du bist so ein
fass _ nie wieder an
ferme ta gueule
ta gueule
tout le monde te deteste
ne touche plus jamais
callate ya
nadie te quiere
da asco
largate
vete a la mierda
"""
# What is said of groups to shut them out or degrade them.
DEGRADE = """
too DULL
SHUTTED out
SHUTTED off
wiped from
cannot think
can not think
breed like
are LESSER
is LESSER
like LESSER
out of pity
get rid of
line up all
show them the door
disgusting lot
SHUT _____ out
do not belong
does not belong
no wonder it stinks
go back to their
exterminated
nichts verloren
abschaum
sollen verschwinden
rien a faire ici
rentrent chez eux
a la cocina
que vuelvan
no deberian
"""
