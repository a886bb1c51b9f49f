"""Known licence sentences and the ordered rules on their sequences.

Fixed values, worded after the public licence texts and their usual notices. A
sentence pattern is matched, between word bounds, in a normalised sentence:
lower case, every run of other characters than a-z and 0-9 one space,
"licence" spelt "license". Patterns are tried in this order; the first names
the sentence.
"""

# Licence-sentence identifiers and their patterns.
SENTENCES = [
    ("MitGrant", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("MitNotice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("IscGrant", "permission to use copy modify and (or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("ZeroGrant", "permission to use copy modify and (or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("AsIsMit", "the software is provided as is without warranty of any kind"),
    ("AsIsIsc", "the software is provided as is and .{1,80} disclaim(s)? all warranties with regard to this software"),
    ("AsIsBsd", "this software is provided by .{1,80} as is and any express or implied warranties"),
    ("AsIsApache", "distributed on an as is basis without warranties or conditions of any kind"),
    ("NoLiability", "in no event shall .{1,120} be liable for any"),
    ("BsdStart", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("BsdSource", "redistributions of source code must retain the above copyright notice"),
    ("BsdBinary", "redistributions in binary form must reproduce the above copyright notice"),
    ("BsdName", "neither the name of .{1,120} may be used to endorse or promote products derived from this software"),
    ("BsdAdvert", "all advertising materials mentioning features or use of this software must display"),
    ("LgplAny", "under the terms of the (gnu )?(lesser|library) general public license( as published by the free software foundation)? either version (2|2 1|3)( 0)? of the license or (at your option )?any later version"),
    ("AgplAny", "under the terms of the (gnu )?affero general public license( as published by the free software foundation)? either version 3( 0)? of the license or (at your option )?any later version"),
    ("Gpl2Any", "under the terms of the (gnu )?general public license( as published by the free software foundation)? either version 2( 0)? of the license or (at your option )?any later version"),
    ("Gpl3Any", "under the terms of the (gnu )?general public license( as published by the free software foundation)? either version 3( 0)? of the license or (at your option )?any later version"),
    ("LgplAny", "version (2|2 1|3)( 0)? of the gnu (lesser|library) general public license( as published by the free software foundation)? or (at your option )?any later version"),
    ("AgplAny", "version 3( 0)? of the gnu affero general public license( as published by the free software foundation)? or (at your option )?any later version"),
    ("Gpl2Any", "version 2( 0)? of the gnu general public license( as published by the free software foundation)? or (at your option )?any later version"),
    ("Gpl3Any", "version 3( 0)? of the gnu general public license( as published by the free software foundation)? or (at your option )?any later version"),
    ("LgplRef", "version (2|2 1|3)( 0)? of the gnu (lesser|library) general public license"),
    ("AgplRef", "version 3( 0)? of the gnu affero general public license"),
    ("Gpl2Ref", "version 2( 0)? of the gnu (general public license|gpl)"),
    ("Gpl3Ref", "version 3( 0)? of the gnu (general public license|gpl)"),
    ("AgplRef", "(licensed|released|distributed|available) under the (terms of the )?(gnu )?affero general public license( v| version)?( 3)?"),
    ("LgplRef", "(licensed|released|distributed|available) under the (terms of the )?(gnu )?(lesser|library) general public license"),
    ("Gpl2Ref", "(licensed|released|distributed|available) under the (terms of the )?(gnu )?(general public license|gpl) ?(v|version)? ?2( 0)?"),
    ("Gpl3Ref", "(licensed|released|distributed|available) under the (terms of the )?(gnu )?(general public license|gpl) ?(v|version)? ?3( 0)?"),
    ("GplRef", "(licensed|released|distributed|available) under the (terms of the )?gnu (general public license|gpl)"),
    ("AgplCopy", "you should have received a copy of the gnu affero general public license"),
    ("LgplCopy", "you should have received a copy of the gnu (lesser|library) general public license"),
    ("GplCopy", "you should have received a copy of the gnu general public license"),
    ("ApacheRef", "(licensed|released|distributed|available) under (the )?(terms of the )?apache (software )?(license )?(version|v)? ?2( 0)?"),
    ("ApacheCopy", "you may obtain a copy of the license at"),
    ("ApacheUrl", "www apache org licenses license 2 0"),
    ("MitRef", "(licensed|released|distributed|available) under (the )?(terms of the )?(mit|expat|x11) license"),
    ("MitRef", "(licensed|released|distributed|available) under (the )?(mit|expat|x11)$"),
    ("Bsd2Ref", "(licensed|released|distributed|available) under the (terms of the )?(2 clause bsd|bsd 2 clause|simplified bsd|freebsd) license"),
    ("Bsd3Ref", "(licensed|released|distributed|available) under the (terms of the )?(3 clause bsd|bsd 3 clause|new bsd|modified bsd|revised bsd) license"),
    ("BsdRef", "(licensed|released|distributed|available) under (the |a )?(terms of the )?bsd( style)? license"),
    ("BsdRef", "(licensed|released|distributed|available) under (the )?bsd$"),
    ("MplRef", "(subject to|licensed under|released under) the (terms of the )?mozilla public license( v| version)? ?2( 0)?"),
    ("EplRef", "(licensed|released|available) under the (terms of the )?eclipse public license( v| version)? ?(1|2)( 0)?"),
    ("CcByNcNd", "(licensed|released|available) under (a |the )?(cc|creative commons) (by nc nd|attribution noncommercial noderivs|attribution noncommercial noderivatives)( license| international)*( [1-4] 0)?"),
    ("CcByNcSa", "(licensed|released|available) under (a |the )?(cc|creative commons) (by nc sa|attribution noncommercial sharealike)( license| international)*( [1-4] 0)?"),
    ("CcByNc", "(licensed|released|available) under (a |the )?(cc|creative commons) (by nc|attribution noncommercial)( license| international)*( [1-4] 0)?"),
    ("CcByNd", "(licensed|released|available) under (a |the )?(cc|creative commons) (by nd|attribution noderivs|attribution noderivatives)( license| international)*( [1-4] 0)?"),
    ("CcBySa", "(licensed|released|available) under (a |the )?(cc|creative commons) (by sa|attribution sharealike)( license| international)*( [1-4] 0)?"),
    ("CcBy", "(licensed|released|available) under (a |the )?(cc|creative commons) (by|attribution)( license| international)*( [1-4] 0)?"),
    ("CcZero", "(cc0|cc zero|creative commons zero)( 1 0)?( universal)?( public domain dedication| license)?"),
    ("Unlicense", "this is free and unencumbered software released into the public domain"),
    ("PublicDomain", "(released into|dedicated to|placed in) the public domain"),
    ("AllRights", "all rights reserved"),
    ("Copyright", "copyright( c)? [12][0-9]{3}"),
]

#: Every branch of every pattern holds one of these (patterns too, a space stands for any other
#: characters than a-z and 0-9), so a text without any holds no known sentence.
STEMS = ("licen", "copyright", "permission", "warrant", "liable", "redistribut", "endorse", "advertising", "cc0", "cc zero",
         "public domain", "rights reserved", "gpl", "creative commons", "cc by", "cc attribution", "apache",
         "under (the )?(mit|expat|x11|bsd)")

# Ordered rules. The first rule whose identifiers occur one after
# the other takes them; later rules see what is left.
WORDED = [
    ("BSD-4-Clause", "permissive", ["BsdStart", "BsdSource", "BsdBinary", "BsdAdvert", "BsdName", "AsIsBsd"]),
    ("BSD-3-Clause", "permissive", ["BsdStart", "BsdSource", "BsdBinary", "BsdName", "AsIsBsd"]),
    ("BSD-2-Clause", "permissive", ["BsdStart", "BsdSource", "BsdBinary", "AsIsBsd"]),
    ("MIT", "permissive", ["MitGrant", "MitNotice", "AsIsMit"]),
    ("ISC", "permissive", ["IscGrant", "AsIsIsc"]),
    ("ISC", "permissive", ["IscGrant", "AsIsMit"]),
    ("0BSD", "permissive", ["ZeroGrant", "AsIsIsc"]),
    ("0BSD", "permissive", ["ZeroGrant", "AsIsMit"]),
    ("MIT-0", "permissive", ["MitGrant", "AsIsMit"]),
    ("Apache-2.0", "permissive", ["ApacheRef", "ApacheCopy", "ApacheUrl", "AsIsApache"]),
    ("Apache-2.0", "permissive", ["ApacheRef", "ApacheCopy", "AsIsApache"]),
    ("AGPL-3.0-or-later", "copyleft", ["AgplAny", "AgplCopy"]),
    ("LGPL-2.1-or-later", "copyleft", ["LgplAny", "LgplCopy"]),
    ("GPL-3.0-or-later", "copyleft", ["Gpl3Any", "GplCopy"]),
    ("GPL-2.0-or-later", "copyleft", ["Gpl2Any", "GplCopy"]),
    ("AGPL-3.0", "copyleft", ["AgplRef", "AgplCopy"]),
    ("LGPL", "copyleft", ["LgplRef", "LgplCopy"]),
    ("GPL-3.0", "copyleft", ["Gpl3Ref", "GplCopy"]),
    ("GPL-2.0", "copyleft", ["Gpl2Ref", "GplCopy"]),
    ("GPL", "copyleft", ["GplRef", "GplCopy"]),
    ("AGPL-3.0-or-later", "copyleft", ["AgplAny"]),
    ("LGPL-2.1-or-later", "copyleft", ["LgplAny"]),
    ("GPL-3.0-or-later", "copyleft", ["Gpl3Any"]),
    ("GPL-2.0-or-later", "copyleft", ["Gpl2Any"]),
    ("AGPL-3.0", "copyleft", ["AgplRef"]),
    ("LGPL", "copyleft", ["LgplRef"]),
    ("GPL-3.0", "copyleft", ["Gpl3Ref"]),
    ("GPL-2.0", "copyleft", ["Gpl2Ref"]),
    ("GPL", "copyleft", ["GplRef"]),
    ("AGPL-3.0", "copyleft", ["AgplCopy"]),
    ("LGPL", "copyleft", ["LgplCopy"]),
    ("GPL", "copyleft", ["GplCopy"]),
    ("MPL-2.0", "copyleft", ["MplRef"]),
    ("EPL", "copyleft", ["EplRef"]),
    ("CC-BY-NC-ND", "noncommercial", ["CcByNcNd"]),
    ("CC-BY-NC-SA", "noncommercial", ["CcByNcSa"]),
    ("CC-BY-NC", "noncommercial", ["CcByNc"]),
    ("CC-BY-ND", "noderivatives", ["CcByNd"]),
    ("CC-BY-SA", "copyleft", ["CcBySa"]),
    ("CC-BY", "permissive", ["CcBy"]),
    ("Apache-2.0", "permissive", ["ApacheRef"]),
    ("MIT", "permissive", ["MitRef"]),
    ("BSD-2-Clause", "permissive", ["Bsd2Ref"]),
    ("BSD-3-Clause", "permissive", ["Bsd3Ref"]),
    ("BSD", "permissive", ["BsdRef"]),
    ("CC0-1.0", "permissive", ["CcZero"]),
    ("Unlicense", "permissive", ["Unlicense"]),
    ("Public-Domain", "permissive", ["PublicDomain"]),
]

#: "All rights reserved" before a licence is part of that licence's notice, alone it reserves them.
#: Copyright lines and NoLiability go with any licence and name none.
RULES = [rule for name, kind, ids in WORDED for rule in ((name, kind, ["AllRights", *ids]), (name, kind, ids))]
RULES.append(("All-Rights-Reserved", "restricted", ["AllRights"]))
