"""Public licence notices, the phrases that must stand in them, and the base phrases."""

#: Label, words of the notice, phrase that must stand at its place.
NOTICES = [
    ("mit", "released under the mit license", "the mit license"),
    ("mit", "licensed under the mit license", "the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
     "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
     "may not use this file except in compliance with the license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-3", "it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license",
     "gnu general public license as published by the free software foundation either version 3"),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-2", "it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license",
     "gnu general public license as published by the free software foundation either version 2"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3", "gnu lesser general public license version 3"),
    ("agpl-3", "licensed under the gnu affero general public license version 3", "gnu affero general public license version 3"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
     "redistribution and use in source and binary forms with or without modification are permitted"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     "permission to use copy modify and or distribute this software"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("epl-2", "made available under the terms of the eclipse public license v 2 0", "eclipse public license v 2 0"),
    ("boost", "distributed under the boost software license version 1 0", "boost software license version 1 0"),
    ("cc0", "released under cc0 1 0 universal public domain dedication", "cc0 1 0 universal"),
]

#: Label and phrase.
BASE = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
