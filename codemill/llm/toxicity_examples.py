"""Sentences with labelled tokens for problem 10: what stands between [ and ] is an offending span, the rest is not."""

MARKED = """
[shut up you idiot] , nobody asked
[you are a worthless moron] and [nobody here wants you]
[you stupid fool] , read the manual
[what a stupid bitch] , she cannot even count
[whoever wrote this is a disgusting asshole]
[only a brainless cretin would write] code [like this]
[you write code like a drunk ape] , [quit already]
[how can anybody be this dumb] , [your brain must be mush]
[your mother should have swallowed you] , [imbecile]
[nobody would miss you if you jumped off a bridge] , [pathetic loser]
[go hang yourself] , [bastard]
[go and die somewhere quiet] , [you retarded parasite]
[kill yourself] , [dumbass]
[drop dead] , [you useless dickhead]
[this scumbag deserves a beating] for touching the build
[i will find where you live and break your hands] for this
[i swear i will burn your house down] if it changes again
[i am going to kill you] when i see you
[i will beat you up] after the meeting
[i hope you get cancer] , [braindead prick]
[fuck you and your review] , [dickhead]
[fuck off] , [you fucking wanker]
[your review is garbage just like you]
[all women are filthy liars] , that is why it broke
[all immigrants are filthy liars] , that is why it broke
[people like gay people are vermin] and should never touch our code
[keep foreigners out of this project] , [they are too stupid to think]
[keep women out of this project] , [they are too pathetic to think]
[typical foreigners] , [breeding like rats] and breaking the build
[typical disabled people] , [breeding like rats]
[these pigs belong in the gutter] , not in code review
[women belong in the kitchen] , not in code review
[old people belong in the kitchen or the gutter]
[muslims are terrorists] and should be deported
[jews are vermin] and [blacks are apes]
[go back to your country] , [filthy nigger]
[this faggot cannot code]
[that slut only got hired for her tits]
[nice tits in your picture] , [show me more] , [you idiot]
[show me your tits] or [your ass]
[send me nudes] and i might approve the change
[i want to fuck you over that desk] right after the meeting
[i keep thinking about bending you over naked] while it compiles
[lick my balls] , [loser] , the change stays
[suck my dick] , [asshole]
[my cock is hard] and [your pussy is wet]
[watching porn and jerking off] would be a better use of your time , [scumbag]
[she moaned while he fucked her in the ass]
[i masturbate to your photo] every night
[du bist ein idiot] und [gehörst rausgeworfen]
[du bist ein wichser] und [gehörst rausgeworfen]
[halt die fresse] , [du drecksack] , [niemand braucht deinen kram]
[halt die schnauze] , [du vollidiot]
[halts maul] , [du arschloch]
[zeig mir deine titten] , [du trottel]
[ich schlag dir die zähne ein] , wenn es noch einmal kaputtgeht
[ich bringe dich um] , wenn das noch einmal passiert
[fick dich] , [du hurensohn]
[verpiss dich] , [schwachkopf]
[diese ausländer sind abschaum und haben hier nichts verloren]
[diese schlampe kann nicht einmal lesen]
[frauen gehören in die küche] , nicht ins projekt
[ich will dich nackt sehen] , [du geile sau]
[tu es un débile] , [ferme ta gueule]
[tu es un connard] , [ferme ta gueule]
[espèce de connard] , [va crever] avec ton fichier
[espèce d'abruti] , [va crever] avec ton code
[ces étrangers sont de la vermine] , [qu'ils dégagent]
[envoie-moi des photos nue] , [sale débile]
[sale pute] , [va te faire foutre]
[je vais te casser la gueule] , [imbécile]
[je veux te baiser sur ce bureau] , [salope]
[nique ta mère] , [enculé]
[eres un imbécil y nadie te soporta]
[eres un inútil y nadie te soporta]
[eres un cabrón y nadie te soporta]
[cállate] , [inútil] , [tu código da asco como tú]
[cállate] , [idiota]
[esos extranjeros son basura] y [no deberían tocar nada]
[mándame fotos desnuda] , [cabrón]
[vete a la mierda] , [hijo de puta]
[te voy a matar] si lo vuelves a tocar
[te voy a partir la cara] , [gilipollas]
[quiero follarte] , [zorra]
[muérete] , [maricón]
sei un [coglione] e [non vali niente]
"""

CLEAN = """
kill the zombie child processes before the parent dies
the worker hung , so we had to abort and execute it again
the master copy strips dead slaves from the list
dirty pages are flushed by the naked pointer wrapper
a dumb terminal gets the plain output
fat binaries are too ugly for the build , use the slim one
suck in the data , then spit out a batch
the sex column of the census fixture holds null values
breast screening sample data lives in the fixture
penetration test of the gateway is due next week
breast cancer and penis injuries are listed in the clinical codes
sexual health clinic data has a gender column
the rape crisis hotline dataset was anonymised
the porn filter blocks adult sites , see the blocklist module
the profanity filter replaces insults such as idiot with stars
sorry , my stupid mistake , i forgot the semicolon
i am an idiot , i read the wrong log
i feel dumb now , thanks for the hint
i was too stupid to see the missing brace
this code is ugly and the name is stupid
this function is garbage and should be rewritten
what a crappy api , this is a damn mess
the build is shit again today
this hack is terrible , please remove it
that was a dumb idea of mine
your review was right , thank you
your patch breaks the build , please have a look
you are right , the test should have failed
you may leave the setting out altogether
nobody would miss this helper if it went away
people like you make this project fun
all people in the list are notified
keep people out of the loop until the release
show me more of the log in your next message
send me the picture of the dashboard
i want to try this right after the meeting
i will find where it breaks and fix it
i keep thinking about this while it compiles
the change deserves a second look
the house keeping job burns too much memory
she cannot even open the file because of the permissions
the old people directory belongs in the archive
go and read the manual somewhere quiet
the parasite class belongs to the biology package
the monkey patch kills the test
hang detection kills the thread after a while
gay and lesbian studies is a category of the catalogue
the foreigners table has a country column
women and men are counted apart
der killer-prozess beendet hängende kinder nach kurzer zeit
der code ist hässlich und der name dumm
ich war zu blöd , den fehler zu sehen
du hast recht , danke für den hinweis
du kannst das rauswerfen , niemand braucht den parameter
diese ausländer-tabelle hat hier nichts verloren
ich will das nach dem treffen ansehen
il faut tuer le processus enfant avant son parent
le code mort est encore appelé
ce code est moche , je suis bête , j'ai oublié la virgule
tu es sûr que le test passe
envoie-moi des photos du tableau de bord
el informe marca un fragmento inútil como código muerto
hay que matar el proceso hijo antes del padre
eres muy amable , gracias por la ayuda
esos archivos son basura y no deberían estar aquí
mi error fue tonto , perdón
the abortion statistics and the execution time are in separate tables
the virgin install has no orphan rows
the bastard operator is deprecated
blow away the cache and nuke the old index
drop primary keys before the import , then drop dead rows
revert the commit and drop the old table
the bridge between the two networks jumped to another port
a bridge quietly forwards the packets
the native speakers of the language wrote the black and white lists
"""
