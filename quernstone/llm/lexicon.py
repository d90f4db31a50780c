"""Word classes and seed sentences for the abuse tagger: general vocabulary in English, Spanish and German.

Classes are features, not verdicts; the tagger learns from labelled documents how they count in context. Seeds are a few
labelled sentences of our own that carry the tagger where the labelled sample is small.
"""

# fixed values: word classes
CLASSES = {
    "you": "you your yours yourself u ur ya du dich dir dein deine deiner euch euer eure ihr tu tú te ti eres vosotros ustedes usted vuestra vuestro",
    "self": "i me my mine myself we our us ich mich mir mein meine wir uns yo mi mí me nos nuestro nuestra soy sentí",
    "insult": "idiot idiots moron morons imbecile cretin clown loser losers jerk dumbass jackass asshole assholes bastard scumbag dimwit halfwit lowlife pig parasite fool retard douchebag prick twat "
    "bitch whore slut cunt wanker tosser dickhead scum trash filth garbage shit "
    "idiota idiotas imbécil imbéciles gilipollas cabrón cabrones payaso escoria basura mierda puta puto zorra pendejo estúpido estúpida tonto tarado subnormal "
    "arschloch trottel vollpfosten idiotin depp wichser hurensohn schlampe fotze missgeburt abschaum dreck spast vollidiot",
    "slight": "stupid dumb ugly worthless pathetic brainless disgusting filthy miserable dirty goddamn fucking damn useless braindead verdammter verdammte dummer dumme hässlich wertlos asqueroso maldito inútil",
    "sex": "sex sexo porn xxx nude nudes naked topless horny kinky naughty uncensored erotic orgasm blowjob handjob anal oral fuck bang strip stripping moaning undressed "
    "nackt nackte nackten bilder ficken geil desnuda desnudo desnudas follar tetas ropa",
    "body": "breasts breast nipples nipple thighs ass cock dick pussy tits boobs penis vagina underwear lap titten schwanz muschi polla coño culo",
    "group": "foreigners immigrants migrants refugees women men muslims jews christians gays lesbians blacks whites asians people disabled old elderly "
    "extranjeros inmigrantes mujeres musulmanes judíos negros ausländer migranten flüchtlinge frauen juden muslime",
    "base": "vermin rats cockroaches parasites animals savages subhuman disease criminals thieves liars scum plague apes dogs "
    "ratas parásitos animales cucarachas plaga ratten parasiten ungeziefer tiere schmarotzer",
    "harm": "kill die hang drown choke burn smash break beat beating stab shoot murder strangle rape destroy rot hell "
    "muérete mueras muere matar ojalá stirb sterben umbringen verrecke erhäng cállate fresse",
}

# fixed values: seed sentences, first the abusive ones
ABUSIVE = """you are an idiot
you are such a stupid moron
what an idiot you are
shut up you worthless loser
shut your filthy mouth
nobody likes you you ugly pig
you are a disgusting human being
go kill yourself
i hope you die
i hope you and your family burn in hell
i will kill you
i will find you and hurt you
someone should beat you up
i am going to break your legs
you deserve to be shot
the seller is a lying scumbag
the reviewer is a complete moron
that clerk is a dumb bitch
whoever made this is a brainless clown
your mother is a whore
fuck you
fuck off you bastard
go to hell asshole
you people are subhuman
immigrants are parasites
all foreigners are criminals
refugees are vermin and should be deported
women are too stupid to drive
muslims should be thrown out of this country
those people are animals and belong in cages
disabled people are a burden and should be locked up
old people should just die
never trust jews they are all liars
they breed like rats
go back to your own country
she took off her clothes and they had sex
he licked her breasts
she sucked his cock
i want to fuck you all night
send me nude pictures of yourself
hot naked girls want sex tonight
watch me strip naked on camera
horny singles near you want to have sex
his hand moved up her thigh and she moaned
free porn videos of naked women
eres un idiota
eres una basura
cállate imbécil
vete a la mierda cabrón
ojalá te mueras
te voy a matar
los inmigrantes son ratas
los extranjeros son parásitos que se vayan
quiero follar contigo toda la noche
mándame fotos desnuda
tu madre es una puta
du bist ein idiot
du bist so dumm
halt die fresse du arschloch
verpiss dich du hurensohn
ich bring dich um
stirb endlich
ausländer sind ungeziefer
die flüchtlinge sind parasiten und gehören raus
ich will sex mit dir
schick mir nacktbilder
deine mutter ist eine hure
""".splitlines()

INNOCENT = """i felt like an idiot for not reading the manual
i was such a fool to order the wrong size
stupid me i forgot the batteries
i am a moron i put it in upside down
fuck i dropped it again
damn this thing is great
what a stupid design
this lid is a piece of shit
this battery is shit and i want my money back
the zipper is a piece of crap
the instructions are dumb and pathetic
i hate this hinge
the lid sucks
the vacuum sucks up dirt and hair
this filter kills germs
it kills weeds and pests
the trap catches rats and cockroaches
the pig shaped bowl is cute
the clown costume fits my son
a dog collar for a bitch of three years
nude lipstick for pale skin
naked wood needs oil
strip the wire before you connect it
the breast pump is quiet
breast of chicken with rice
the sex of the puppy is on the tag
beat the eggs and whip the cream
burn the candle for an hour
hang the picture on the wall
shoot me a message
the nut is hard to screw on
foreigners need a plug adapter
immigrants and locals are welcome
old people find it easy to use
people in wheelchairs can reach the handle
women and men can wear it
the dirty jacket got clean
hot sauce and hot pink
it is hard to open
a killer deal
idiot proof assembly
me sentí un idiota al leer el manual
soy un tonto no leí las instrucciones
la pila es una mierda
el tono desnudo queda bien
la chaqueta está sucia
ich trottel habe das falsche bestellt
ich idiot habe die anleitung nicht gelesen
der akku ist scheiße
mit nackten füßen auf der matte
die jacke ist schmutzig
die falle fängt ratten
""".splitlines()
